"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_passages import passages

    return passages(_documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_suffixes import digest, remove_repeats

    return digest(remove_repeats(_documents(spark, sf_dir)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_lm_scoring import score

    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and coalesce(toxic, 0) = 0")
    found = score(_documents(spark, sf_dir), good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_secrets import digest, find_secrets

    return digest(find_secrets(_documents(spark, sf_dir)))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_lines import dedup_lines

    return dedup_lines(_documents(spark, sf_dir)).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_decontaminate import leaks

    found = leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), (F.size("hits") > 0).alias("contaminated"), F.array_max(F.transform("hits", lambda h: h["similarity"])).alias("similarity"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_sharding import shard

    return shard(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .op7_packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_quality import label_documents

    return label_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffixes, op2_lm_scoring, op3_secrets, op4_lines, op5_decontaminate, op6_sharding, op7_packing, op8_quality, op9_passages, op10_minhash)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Holds while the corpus has no more words than the models' vocabulary, so that no word is unknown.
_LM_SQL = f"""
with good as (select distinct doc_id from labels where quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null),
docs as (select row_number() over () as r, doc_id, {_WORDS} as words, coalesce(doc_id in (select doc_id from good), false) as target from documents),
tokens as (select r, target, unnest(words) as w, unnest(list_prepend(null, words)[1:len(words)]) as v from docs),
pairs as (select v, w, count(*) as all_n, count(*) filter (where target) as target_n from tokens group by v, w),
words as (select w, sum(all_n) as all_n, sum(target_n) as target_n from pairs group by w),
contexts as (select v, sum(all_n) as all_n, sum(target_n) as target_n from pairs group by v),
total as (select coalesce(sum(all_n), 0) as all_n, coalesce(sum(target_n), 0) as target_n, count(*) as size, greatest(1, coalesce(sum(target_n), 0)) / greatest(1, coalesce(sum(all_n), 0))::double as scale from words),
losses as (
    select p.v, p.w,
        -ln((p.target_n + 4 * (w.target_n + 1)::double / (t.target_n + t.size + 1)) / (c.target_n + 4)) as target_loss,
        -ln((p.all_n * t.scale + 4 * (w.all_n * t.scale + 1) / (t.all_n * t.scale + t.size + 1)) / (c.all_n * t.scale + 4)) as all_loss
    from pairs p join words w using (w) join contexts c on c.v is not distinct from p.v cross join total t
),
sums as (select r, avg(target_loss) as target_loss, avg(all_loss) as all_loss from tokens k join losses l on l.w = k.w and l.v is not distinct from k.v group by r)
select doc_id, len(words)::bigint as n_tokens, round(target_loss, 6) as target_loss, round(all_loss, 6) as background_loss, round(all_loss - target_loss, 6) as score
from docs left join sums using (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lm_scoring": _LM_SQL}
