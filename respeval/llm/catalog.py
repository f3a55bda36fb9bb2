"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.llm import (
    decontaminate,
    fingerprints,
    fixity,
    language_id,
    line_templates,
    mixture,
    ngram_join,
    secrets,
    sharding,
    token_alignment,
    token_counts,
    toxicity,
    whitening,
)
from respeval.llm.common import stored, table


def op1_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balance(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def number(kind: int):
        return F.size(F.filter("base", lambda b: b.kind == kind)).cast("long")

    return spans.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"),
        secrets.span_list(F.concat("base", "random")).alias("spans"),
    )


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.dropped_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("dropped", F.array_join("dropped", ","))


def op4_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against one of its own, in which some records are damaged or lost.

    Records whose id is divisible by 101 are longer in the replica, by 103 lost.
    """
    pages = table(spark, sf_dir, "pages")
    html = F.concat(F.coalesce("html", F.lit("")), F.lit("damaged"))
    other = pages.filter(F.coalesce(F.col("page_id") % 103 != 0, F.lit(True)))
    other = other.withColumn("html", F.when(F.col("page_id") % 101 == 0, html).otherwise(F.col("html")))
    primary = stored(fixity.archive_index(pages, "page_id", "url", "html"), "index")
    replica = stored(fixity.archive_index(other, "page_id", "url", "html"), "replica")
    return fixity.audit(primary, replica).withColumnRenamed("key", "page_id")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op6_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_counts.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag_documents(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    held_out = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "n_words")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.alignment(
        table(spark, sf_dir, "documents"),
        token_alignment.read_byte_level(public_tokenizers.path("byte_bpe_50k.json")),
        token_alignment.read_sentencepiece(public_tokenizers.path("piece_bpe_32k.model")),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_shards,
        op2_secret_scan,
        op3_line_templates,
        op4_fixity_audit,
        op5_ngram_jaccard_join,
        op6_source_mixture,
        op7_token_counts,
        op8_fingerprints,
        op9_toxicity,
        op10_decontamination,
        op11_language_id,
        op12_whitening,
        op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op3_line_templates": r"""
with t as (
    select distinct text from documents where text is not null
), l as (
    select text, unnest(string_split(text, chr(10))) as value,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 as line
    from t
), k as (
    select text, line, string_split_regex(
        regexp_replace(value, '[^ \t]*[0-9][^ \t]*', '*', 'g'), '[ \t]+') as tokens
    from l where trim(translate(value, chr(9), ' ')) <> ''
), kinds(enough, least) as (
    -- Texts that must share a template, and constants that it needs.
    values (5, 0), (2, 10)
), leaves as (
    select n, lead, count(distinct text) as texts
    from (select text, len(tokens) as n, tokens[1:3] as lead from k) group by n, lead having count(*) > 1
), held as (
    select k.*, len(tokens) as n, tokens[1:3] as lead from k
    where (len(tokens), tokens[1:3]) in (select (n, lead) from leaves where texts >= 5 or texts >= 2 and n >= 10)
), each as (
    select text, line, n, lead, unnest(tokens) as token, generate_subscripts(tokens, 1) as place from held
), seen as (
    select n, lead, place, token, count(distinct text) as texts from each where token <> '*'
    group by n, lead, place, token
), whole as (
    select e.text, e.line, e.n, e.lead, enough, least, count(c.token) as constants,
        list(coalesce(c.token, '*') order by e.place) as template
    from each e cross join kinds left join seen c
        on e.n = c.n and e.lead = c.lead and e.place = c.place and e.token = c.token and c.texts >= enough
    group by e.text, e.line, e.n, e.lead, enough, least
), fit as (
    select * from whole where 2 * constants >= n and constants >= least
), common as (
    select n, lead, enough, template from fit
    group by n, lead, enough, template having count(distinct text) >= enough
), dropped as (
    select text, list(distinct line order by line) as lines
    from fit w join common c
        on w.n = c.n and w.lead = c.lead and w.enough = c.enough and w.template = c.template
    group by text
)
select doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
    coalesce(len(lines), 0)::bigint as n_dropped, coalesce(array_to_string(lines, ','), '') as dropped
from documents d left join dropped x on d.text = x.text
""",
    "op4_fixity_audit": r"""
select page_id,
    coalesce(sum(length) over (order by page_id, digest rows between unbounded preceding and 1 preceding),
        0)::bigint as "offset",
    length, digest, status
from (
    select page_id, (strlen(coalesce(url, '')) + strlen(coalesce(html, '')) + 128)::bigint as length,
        sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) as digest,
        case when page_id % 103 = 0 then 'missing' when page_id % 101 = 0 then 'corrupt' else 'ok' end as status
    from pages
)
""",
    "op10_decontamination": r"""
with w as (
    select doc_id, row_number() over () as rid,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from documents
), b as (
    select item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
    from benchmark
), windows as (
    select item_id, least(10, len(words)) as size,
        unnest([words[i : i + least(10, len(words)) - 1] for i in range(1, greatest(len(words) - 9, 1) + 1)]) as gram
    from b where len(words) > 0
), grams as (
    select gram, size, list(distinct item_id) as items from windows group by gram, size
), sizes as (
    select distinct size from grams
), places as (
    select rid, size, unnest(range(1, len(words) - size + 2)) as pos, words
    from w, sizes where len(words) >= size
), hits as (
    select p.rid, p.pos, p.size, g.items
    from places p join grams g on g.size = p.size and g.gram = p.words[p.pos : p.pos + p.size - 1]
), hit_words as (
    select rid, count(distinct place) as n_hit
    from (select rid, unnest(range(pos, pos + size)) as place from hits) group by rid
), hit_items as (
    select rid, list_sort(list(distinct item::varchar)) as items
    from (select rid, unnest(items) as item from hits) group by rid
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
    coalesce(len(items), 0)::bigint as n_items,
    sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit_words using (rid) left join hit_items using (rid)
""",
    "op6_source_mixture": r"""
with recursive d as (
    select doc_id, source, text,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':17'), 1, 13))::bigint + 0.5::double)
            / 4503599627370496::double as u,
        case when length(text) > 0
            then 0.1::double + 0.9::double * length(regexp_replace(text, '[^\p{L} ]+', '', 'g'))::double
                / length(text)
            else 0.1::double end as quality
    from documents
), s as (
    select source, sum(size)::bigint as source_size,
        [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from d group by source
), level(n, capped) as (
    -- Cap what is above three times its size, share the rest anew, until nothing is above.
    select 0, [] :: varchar[]
    union all
    select n + 1, (
        select list(coalesce(source, chr(0))) from s
        where list_contains(capped, coalesce(source, chr(0))) or 3 * source_size * (
            select sum(weight) from s where not list_contains(capped, coalesce(source, chr(0)))
        ) <= weight * ((select sum(source_size) from s) - coalesce((
            select sum(3 * source_size) from s where list_contains(capped, coalesce(source, chr(0)))), 0))
    )
    from level where n < (select count(*) from s)
), final as (
    select coalesce(capped, []) as capped from level order by n desc limit 1
), t as (
    select source, source_size, case when list_contains(capped, coalesce(source, chr(0)))
        then (3 * source_size)::double
        else ((select sum(source_size) from s) - coalesce((
                select sum(3 * source_size) from s where list_contains(capped, coalesce(source, chr(0)))), 0))::double
            * weight / (select sum(weight) from s where not list_contains(capped, coalesce(source, chr(0))))
        end as target
    from s, final
), g as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t
), r as (
    select d.doc_id, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as rest,
        coalesce(sum(d.size) over (
            partition by d.source order by -ln(u) / quality, coalesce(d.doc_id::varchar, '')
            rows between unbounded preceding and 1 preceding), 0) as ahead
    from d join g on d.source is not distinct from g.source
)
select doc_id, size, source_size::bigint as source_size, target,
    (size * (epochs + case when 2 * ahead + size <= 2 * rest then 1 else 0 end))::bigint as taken
from r
""",
}
