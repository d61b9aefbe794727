"""URL filter by cascades of Bloom filters.

A cascade answers exactly for every key of a known universe: level 0 encodes the listed keys, level 1 the unlisted keys
that pass level 0, level 2 the listed keys that pass level 1, and so on until nothing is left over. Keys are dealt to
shards by hash, each shard's cascade is built in one task from at most about KEYS_PER_SHARD distinct keys, and look-ups
test 128-bit hashes of the keys against broadcast groups of shards of bounded size: no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladingcheck.llm.shared import ascii_lower, partitions, stored
from ladingcheck.llm.words import mix

KEYS_PER_SHARD = 1 << 18
BITS_PER_KEY = 8
HASHES = 5
#: Shards that are broadcast at once: a shard has at most about 0.4 MB, so at most about 50 MB.
SHARDS_AT_ONCE = 128
#: More levels than this only happen if listed and unlisted keys have equal 128-bit hashes.
MOST_LEVELS = 64


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15 >> 8)
    a, b = mix(h1 ^ salt), mix(h2 + salt) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _inside(filter_: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    at = _places(h1, h2, level, len(filter_) * 8)
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def cascade_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """The filters of one shard."""
    levels: list[np.ndarray] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) == MOST_LEVELS:
            raise ValueError("listed and unlisted keys share their hashes")
        bits = np.zeros(max(8, (BITS_PER_KEY * len(inside) + 7) // 8), np.uint8)
        at = _places(h1[inside], h2[inside], len(levels), len(bits) * 8).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        passed = outside[_inside(bits, h1[outside], h2[outside], len(levels))]
        levels.append(bits)
        inside, outside = passed, inside
    return levels


def member(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    answer = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for level, bits in enumerate(levels):
        passed = _inside(bits, h1[open_], h2[open_], level)
        answer[open_[~passed]] = level % 2 == 1
        open_ = open_[passed]
    answer[open_] = len(levels) % 2 == 1
    return answer


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def build(universe: DataFrame) -> DataFrame:
    """shard, shards, levels of the cascades over rows (key, listed); a key is listed if any of its rows says so."""
    keys = stored(universe.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed")).select(
        hashes(F.col("key")).alias("h"), "listed"), "keys")
    shards = max(partitions(universe.sparkSession), -(-keys.count() // KEYS_PER_SHARD))

    def one(part: pa.Table) -> pa.Table:
        h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        levels = cascade_levels(h1, h2, part.column("listed").to_numpy(zero_copy_only=False))
        return pa.table({"shard": part.column("shard").slice(0, 1), "shards": pa.array([shards], pa.int64()),
                         "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))})

    dealt = keys.select(F.pmod("h.h2", F.lit(shards)).alias("shard"), "h.h1", "h.h2", "listed")
    return stored(dealt.groupBy("shard").applyInArrow(one, "shard long, shards long, levels array<binary>"), "cascade")


def look_up(rows: DataFrame, keys: str, cascade: DataFrame, out: str) -> DataFrame:
    """rows with `out`: for each key of the array column `keys` whether it is listed. The keys must be in the universe."""
    spark: SparkSession = rows.sparkSession
    shards = cascade.agg(F.max("shards")).first()[0] or 1
    rows = rows.withColumn("_h", F.transform(keys, lambda k: hashes(k))).withColumn(
        out, F.transform(keys, lambda k: F.lit(False)))
    for first in range(0, shards, SHARDS_AT_ONCE):
        part = cascade.where((F.col("shard") >= first) & (F.col("shard") < first + SHARDS_AT_ONCE)).collect()
        sent = spark.sparkContext.broadcast({r["shard"]: [bytes(x) for x in r["levels"]] for r in part})
        rows = rows.mapInArrow(_tester(sent, shards, out), rows.schema)
    return rows.drop("_h")


def _tester(sent, shards: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: [np.frombuffer(x, np.uint8) for x in v] for k, v in sent.value.items()}
        for batch in batches:
            names = batch.schema.names
            column, old = batch.column(names.index("_h")), batch.column(names.index(out))
            flat = column.flatten()
            h1, h2 = (flat.field(i).to_numpy().view(np.uint64) for i in (0, 1))
            shard = h2.view(np.int64) % shards
            answer = np.array(old.flatten().to_numpy(zero_copy_only=False), bool)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)) if len(order) else []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                if (levels := filters.get(int(shard[order[a]]))) is not None:
                    at = order[a:b]
                    answer[at] = member(levels, h1[at], h2[at])
            lengths = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            arrays = list(batch.columns)
            arrays[names.index(out)] = pa.ListArray.from_arrays(ends, pa.array(answer))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def parts(name: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the column `name`; both empty without ://, null for null."""
    rest = F.expr(f"CASE WHEN locate('://', `{name}`) > 0 THEN substring(`{name}`, locate('://', `{name}`) + 3) ELSE '' END")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed_host of every page.

    rules: (verdict, host + path) pairs or a frame (verdict, rule). A rule fits its host and all subdomains if the path
    starts with the rule's; the longest fitting rule wins. Where none fits, the verdict is block if the host is one that
    a block rule decides for on any page, else allow; `listed_host` says so. The keys of the cascades are all ends of the
    corpus's hosts joined with the starts of its paths of the lengths that rules have, and all its hosts.

    Null or malformed urls have empty host and path, no rule and the verdict allow. Repeated rows, null page_ids and
    further columns are fine; only page_id and url are read. An empty table gives none.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, rule string")
    lengths = sorted(r[0] for r in rules.select(F.length(F.regexp_extract("rule", "/.*", 0))).distinct().collect())
    host, path = parts("url")
    urls = pages.select("page_id", "url").select("page_id", F.coalesce(host, F.lit("")).alias("host"),
                                                 F.coalesce(path, F.lit("")).alias("path"))
    labels = F.split("host", r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s)))))
    urls = urls.withColumn("keys", keys).withColumn("tagged", F.concat(
        F.transform("keys", lambda k: F.concat(F.lit("allow "), k)),
        F.transform("keys", lambda k: F.concat(F.lit("block "), k))))
    universe = urls.select(F.explode("tagged").alias("key"), F.lit(False).alias("listed")).unionAll(
        rules.select(F.concat_ws(" ", "verdict", "rule").alias("key"), F.lit(True)))
    found = look_up(urls, "tagged", build(universe), "fits")
    hits = F.filter(F.arrays_zip("tagged", "fits"), lambda z: z["fits"])
    best = F.array_max(F.transform(hits, lambda z: F.struct(F.length(F.substring_index(z["tagged"], " ", -1)).alias("n"),
                                                            z["tagged"].alias("t"))))
    ruled = found.select("page_id", "host", "path", best["t"].alias("best"))
    ruled = stored(ruled.select("page_id", "host", "path", F.expr("substring(best, 7)").alias("rule"),
                                F.expr("substring(best, 1, 5)").alias("verdict")), "ruled")
    hosts = ruled.where("host <> ''").select(F.col("host").alias("key"), (
        F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("listed"))
    asked = ruled.withColumn("names", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array("host")))
    known = look_up(asked, "names", build(hosts), "known").withColumn(
        "listed_host", F.coalesce(F.get("known", F.lit(0)), F.lit(False)))
    return known.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(
        F.col("listed_host"), "block").otherwise("allow")).alias("verdict"), "listed_host")
