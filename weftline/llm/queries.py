"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, media, pii, quality, secret_scan, suffix_dedup, token_files, window_dedup
from .common import documents, emit, pick, text_rows


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(documents(spark, sf_dir))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(documents(spark, sf_dir)))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes in one pass of the workers, so that ids needn't travel to the JVM and back."""
    path = bpe.default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.load(path)
        decimal = [str(i) for i in range(vocab.size)]
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

        def rows() -> Iterator[tuple]:
            for doc, _, raw in bpe.encoded(path, text_rows(batches)):
                ids = np.frombuffer(raw, "<u4")
                yield doc, len(ids), sha(",".join(map(decimal.__getitem__, ids.tolist()))), sha(vocab.decode(ids))

        return emit(schema, rows())

    return pick(documents(spark, sf_dir)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words", "distance")).alias("b")
    one = found.groupBy("doc_id", "item_id").agg(best)
    return one.select("doc_id", "item_id", F.round(-F.col("b.s"), 9).alias("similarity"), "b.start_word", "b.n_words", "b.distance")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = window_dedup.remove(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_suffix_array_dedup, op3_secret_scans, op4_bpe_round_trip, op5_ngram_jaccard_join, op6_benchmark_decontamination, op7_token_files, op8_quality_classifier, op9_substring_dedup, op10_personal_data)}


#: Strings of 50 bytes and word windows, and exact similarity joins, in SQL; the other operators have none, and are tested against brute force instead.
OP2_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select doc_id, p, substr(h, 2 * p + 1, 1098) as part from docs, unnest(range(0, len(h) // 2, 500)) as u(p)),
starts as (select doc_id, p + j as i, substr(part, 2 * j + 1, 100) as s from parts, unnest(range(0, least(500, greatest(len(part) // 2 - 49, 0)))) as u(j)),
gone as (select doc_id, i from starts join (select s, min(doc_id) as first from starts group by s having min(doc_id) < max(doc_id)) using (s) where first < doc_id),
cuts as (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as new from gone),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select *, count(*) filter (where new) over (partition by doc_id order by i) as run from cuts) group by doc_id, run),
pieces as (select doc_id, a as place, substr(h, 2 * coalesce(lag(b) over w, 0) + 1, 2 * (a - coalesce(lag(b) over w, 0))) as piece from runs join docs using (doc_id) window w as (partition by doc_id order by a)
union all select doc_id, len(h), substr(h, 2 * coalesce(last, 0) + 1) from docs left join (select doc_id, max(b) as last from runs group by doc_id) using (doc_id)),
kept as (select doc_id, string_agg(piece, '' order by place) as k from pieces group by doc_id),
sums as (select doc_id, sum(b - a) as n, count(*) as c from runs group by doc_id)
select doc_id, len(h) // 2 as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(c, 0) as n_spans, sha256(unhex(k)) as kept_sha256 from docs join kept using (doc_id) left join sums using (doc_id)
"""

OP5_SQL = r"""
with recursive docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from docs, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as u(i)),
sets as (select doc_id, sha256(string_agg(s, chr(10) order by s)) as sid, count(*) as n from shingles group by doc_id),
reps as (select sid, min(doc_id) as doc_id, any_value(n) as n, count(*) as copies from sets group by sid),
grams as (select sid, n, s from reps join shingles using (doc_id)),
links as (select a.sid as a, b.sid as b from grams a join grams b on a.s = b.s and a.sid <> b.sid and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by a.sid, b.sid, a.n, b.n having 9 * count(*) >= 4 * (a.n + b.n)),
reached(a, b) as (select sid, sid from reps union select r.a, l.b from reached r join links l on r.b = l.a),
classes as (select a as sid, min(doc_id) as class_id from reached join reps on b = sid group by a),
counts as (select a as sid, sum(copies) as others from links join reps on b = sid group by a)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, (coalesce(others, 0) + coalesce(copies - 1, 0))::bigint as n_links
from docs d left join sets using (doc_id) left join (select sid, copies from reps) using (sid) left join classes using (sid) left join counts using (sid)
"""

OP9_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, w[i] as word, i, case when i + 12 <= len(w) then array_to_string(w[i:i + 12], ' ') end as win from docs, unnest(range(1, len(w) + 1)) as t(i)),
starts as (select *, win is not null and min(doc_id) over (partition by win) < doc_id as gone from words),
marked as (select *, coalesce(bool_or(gone) over (partition by doc_id order by i rows between 12 preceding and current row), false) as off from starts),
kept as (select doc_id, count(*) as n_words, count(*) filter (where off) as n_removed, string_agg(word, ' ' order by i) filter (where not off) as kept from marked group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs d left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_dedup": OP2_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op9_substring_dedup": OP9_SQL}
