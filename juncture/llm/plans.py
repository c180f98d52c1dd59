"""Registered queries of the operators, and their oracle SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juncture.llm import bpe, chat, exact_dedup, html, language, mixing, packing, repeats, simhash, spelling, topk, toxicity, whitening
from juncture.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public vocabulary and the pattern that cuts texts into pieces."""
    import public_tokenizers

    return public_tokenizers.path(vocabulary), public_tokenizers.PATTERN


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = fold(F.col("doc_id"), 4)
    model = language.fit(docs.select("doc_id", "text", "lang").filter(part != 2))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # a conversation whose texts look like the template's own markers
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], convs.schema)
    segments = chat.format_conversations(convs.unionByName(probe))
    return chat.read_back(segments, in_order=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = fold(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(part != 0)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer("word_bpe_49k.json")[0])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_source_mixing,
        op2_exact_dedup,
        op3_language_id,
        op4_chat_format,
        op5_toxicity,
        op6_suffix_dedup,
        op7_html_main_text,
        op8_byte_bpe,
        op9_simhash_near_dedup,
        op10_exact_top_k,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_mixture_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": r"""
with recursive docs as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), n as (
    select greatest(64, pow(2, ceil(log2(greatest(1, ceil(count(*) / 1048576.0)))))::bigint) as parts from documents
), ranked_sources as (
    select source, source_size, row_number() over (order by source nulls last) - 1 as i
    from (select source, sum(size)::bigint as source_size from docs group by source)
), weighted as (
    select source, source_size, [5, 2, 1][(i % 3 + 1)::int] as weight from ranked_sources
), fill as (
    -- share what is left by weight, stop the sources above three times their size, again until none is
    select 0 as step, source, source_size, weight, null::double as stopped,
        (sum(source_size) over ())::double / (sum(weight) over ()) as level
    from weighted
    union all
    select step + 1, source, source_size, weight, stopped,
        greatest(0, sum(case when stopped is null then 0 else -stopped end) over () + sum(source_size) over ())
            / nullif(sum(case when stopped is null then weight else 0 end) over (), 0)
    from (
        select step, source, source_size, weight,
            case when stopped is not null then stopped when level * weight > 3 * source_size then 3.0 * source_size end as stopped,
            bool_or(stopped is null and level * weight > 3 * source_size) over () as more
        from fill
    ) where more
), aimed as (
    select source, source_size, coalesce(stopped, level * weight) as target
    from fill where step = (select max(step) from fill)
), keyed as (
    select doc_id, source, size,
        case when size < 16 then size else length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) - 8 end as class,
        ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % (select parts from n) as part
    from docs
), placed as (
    select k.doc_id, k.size, a.source_size, a.target,
        row_number() over (partition by k.source order by class desc, part, k.size desc, k.doc_id nulls first) as place,
        case when a.source_size > 0 then a.target / a.source_size else 0 end as rate,
        (('0x' || substr(md5('mix' || (k.source is not null)::varchar || coalesce(k.source, '')), 1, 8))::bigint % 65536) / 65536.0::double as u
    from keyed k join aimed a on k.source is not distinct from a.source
)
select doc_id, size, source_size, target, size * (floor(place * rate + u) - floor((place - 1) * rate + u))::bigint as taken from placed
""",
    "op2_exact_dedup": """
with docs as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
    row_number() over (partition by norm order by doc_id desc nulls last) = 1 as kept, sha256(norm) as text_sha256
from docs window same as (partition by norm)
""",
    "op10_exact_top_k": """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
    from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5
""",
}
