"""The versioned chunk table, in buckets of paths.

A path belongs to the bucket that the low bits of its CRC-32 name.  A version is
a manifest that names the pieces (Parquet directories) of each bucket; a change
writes pieces for the buckets that it touches, then the next manifest, which is
renamed into place.  Manifests are never changed, and the highest one counts, so
a reader sees a whole version or the one before, never nothing.  Postings lie
beside the chunks, piece by piece, and a manifest sums up chunks and tokens, so
keyword search needs neither texts nor counts.  It also has each bucket's files,
languages and last time, which add up, since a path lies in one bucket: status
and statistics read no chunks.

Deleting and replacing files rewrites nothing: the (path, branch) pairs that go
are a small table of their own, and readers leave out by an anti-join what was
written before that.  A bucket is written anew, without what is gone, when it
has many pieces or many such pairs, or is half gone; one that has grown beyond
a size is split in two by one more bit, so buckets keep their size however the
store grows, and the pieces of other buckets stay as they are.

The table lies below one folder of any file system that Spark writes.  One
writer at a time is assumed; a second one fails at the manifest.
"""

from __future__ import annotations

import copy
import json
import math
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import chunk_id
from .operators import search, stats
from .operators.filters import Filters
from .schema import CHUNK, POSTING

CACHE_SIZE = 100
BUCKETS = 64  # of a new store, at least
PIECES = 8  # of a bucket, beyond which it is written as one
SPLIT = 1_000_000  # chunks of a bucket, beyond which it is split
DEPTH = 30  # bits of a bucket's name, at most: one path alone cannot be split
GONE = 10_000  # pairs that are gone from a bucket, beyond which it is written without them
LISTS = 32  # of pairs that are gone, beyond which they are written as one
FEW = 1000  # paths that are looked up by name; more are joined
PAIRS = "path string, branch string, seq int, bucket int, chunks long, tokens long, chars long"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, split: int = SPLIT):
        self.spark, self.path, self._buckets, self._split = spark, path.rstrip("/"), buckets, split
        self._cache: OrderedDict[tuple, list[Row]] = OrderedDict()
        self._known: tuple[str, dict] | None = None

    # Versions ------------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        make = jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), make

    def _names(self, folder: str) -> list[str]:
        fs, make = self._fs()
        where = make(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def version(self) -> str | None:
        """The current version; None before the first write."""
        found = [n for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]
        return found[-1].removesuffix(".json") if found else None

    def manifest(self, version: str | None = None) -> dict:
        """depth (bits of a bucket's name at first), split (buckets that were), buckets: the pieces of each with their chunks, tokens and characters, gone: what of the buckets' older pieces does not count, about: files, last time and chunks by language of each bucket."""
        version = version or self.version()
        if version is None:
            number = self._buckets or max(BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            return {"depth": max(0, math.ceil(math.log2(number))), "split": [], "buckets": {}, "gone": {}, "about": {}}
        if self._known is None or self._known[0] != version:
            text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first().value
            self._known = version, json.loads(text)
        return self._known[1]

    def _pieces(self, kind: str, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The rows of some buckets (all) that count, with their bucket and piece."""
        wanted = manifest["buckets"] if buckets is None else {str(b) for b in buckets} & set(manifest["buckets"])
        paths = [f"{self.path}/{kind}/bucket={b}/piece={p}" for b in wanted for p in manifest["buckets"][b]]
        if not paths:
            return None
        schema = CHUNK if kind == "chunks" else POSTING
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("piece", T.StringType())])).parquet(*paths)
        return self._alive(rows, manifest, wanted)

    def _alive(self, rows: DataFrame, manifest: dict, buckets: Iterable[str]) -> DataFrame:
        """rows (path, branch, piece) without those of pieces that are older than their deletion."""
        written = F.substring("piece", 1, 8).cast("int")
        gone = {name: g for name, g in manifest["gone"].items() if not g["buckets"].keys().isdisjoint(buckets)}
        for g in gone.values():
            if g["branch"] is not None:
                rows = rows.where(~F.coalesce(F.col("branch") == g["branch"], F.lit(False)) | (written >= g["seq"]))
        lists = [f"{self.path}/gone/{name}" for name, g in gone.items() if g["branch"] is None]
        if not lists:
            return rows
        pairs = self.spark.read.schema(PAIRS).parquet(*lists).groupBy("path", "branch").agg(F.max("seq").alias("seq")).select(F.col("path").alias("_p"), F.col("branch").alias("_b"), "seq")
        return rows.join(pairs, (F.col("path") == F.col("_p")) & F.col("branch").eqNullSafe(F.col("_b")) & (written < F.col("seq")), "left_anti")

    def wide(self, version: str | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The chunks with their bucket, by which a join reads only the buckets it needs."""
        rows = self._pieces("chunks", self.manifest(version), buckets)
        if rows is None:
            return self.spark.createDataFrame([], CHUNK).withColumn("bucket", F.lit(0))
        return rows.select(*CHUNK.names, "bucket")

    def chunks(self, version: str | None = None) -> DataFrame:
        return self.wide(version).drop("bucket")

    def chunks_at(self, paths: DataFrame) -> DataFrame:
        """The chunks of the buckets of some paths (a column); of these paths alone, if they are few."""
        names, buckets = self._located(paths, self.manifest())
        rows = self.wide(buckets=buckets)
        return (rows if names is None else rows.where(F.col("path").isin(names))).drop("bucket")

    def index(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Postings and corpus statistics of the current version."""
        manifest = self.manifest()
        found = self._pieces("postings", manifest)
        if found is None:
            return None, None
        n, tokens = self._sums(manifest)
        return found.drop("piece"), self.spark.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avgdl double")

    @staticmethod
    def _held(manifest: dict, bucket: str) -> tuple[int, int, int, int]:
        """Of a bucket: chunks and tokens written, chunks and pairs gone, tokens gone are taken off."""
        pieces = manifest["buckets"][bucket].values()
        gone = [g["buckets"][bucket] for g in manifest["gone"].values() if bucket in g["buckets"]]
        return sum(c[0] for c in pieces), sum(c[1] for c in pieces) - sum(g[2] for g in gone), sum(g[1] for g in gone), sum(g[0] for g in gone)

    @classmethod
    def _sums(cls, manifest: dict) -> tuple[int, int]:
        held = [cls._held(manifest, b) for b in manifest["buckets"]]
        return sum(h[0] - h[2] for h in held), sum(h[1] for h in held)

    @staticmethod
    def _chars(manifest: dict, bucket: str) -> int | None:
        """The characters of a bucket's chunks; None if an earlier writer did not note them."""
        pieces = manifest["buckets"][bucket].values()
        gone = [g["buckets"][bucket] for g in manifest["gone"].values() if bucket in g["buckets"]]
        if any(len(c) < 3 for c in pieces) or any(len(g) < 4 for g in gone):
            return None
        return sum(c[2] for c in pieces) - sum(g[3] for g in gone)

    def _note(self, manifest: dict, old: dict) -> None:
        """Sum up the buckets that differ from those of an older manifest, or that it says nothing about; neither texts nor vectors are read."""
        state = lambda m, b: (m["buckets"].get(b), self._held(m, b) if b in m["buckets"] else None)
        known = old.get("about", {})
        about = {b: known[b] for b in manifest["buckets"] if b in known and state(manifest, b) == state(old, b)}
        rows = self._pieces("chunks", manifest, set(manifest["buckets"]) - set(about))
        if rows is not None:
            about |= {b: [0, None, {}] for b in manifest["buckets"] if b not in about}
            languages = rows.groupBy("bucket", "language").agg(F.count("*").alias("n"), F.max("indexed_at").alias("last"), F.lit(False).alias("files"))
            files = rows.groupBy("bucket").agg(F.countDistinct("path").alias("n")).select("bucket", F.lit(None).cast("string").alias("language"), "n", F.lit(None).cast("double").alias("last"), F.lit(True).alias("files"))
            for r in languages.unionByName(files).collect():  # a few rows for each bucket
                mine = about[str(r.bucket)]
                if r.files:
                    mine[0] = r.n
                else:
                    mine[1] = max((x for x in (mine[1], r.last) if x is not None), default=None)
                    mine[2][r.language] = r.n
        manifest["about"] = about

    # Buckets -------------------------------------------------------------------------------

    def bucket(self, path: str) -> int:
        return self._bucket_of(path, self.manifest())

    @staticmethod
    def _bucket_of(path: str, manifest: dict) -> int:
        h, depth, split = zlib.crc32(path.encode()), manifest["depth"], set(manifest["split"])
        while (found := 1 << depth | h & (1 << depth) - 1) in split:
            depth += 1
        return found

    @staticmethod
    def _bucket(path: Column, manifest: dict) -> Column:
        at: dict[int, list[int]] = {}
        for b in manifest["split"]:
            at.setdefault(b.bit_length() - 1, []).append(b)
        named = lambda depth: (F.crc32(path.cast("binary")).bitwiseAND(F.lit((1 << depth) - 1)) + (1 << depth)).cast("int")
        last = max(at, default=manifest["depth"] - 1) + 1
        out = named(last)
        for depth in reversed(range(manifest["depth"], last)):
            out = F.when(named(depth).isin(at.get(depth, [])), out).otherwise(named(depth))
        return out

    def _located(self, paths: DataFrame, manifest: dict) -> tuple[list[str] | None, list[int]]:
        """The paths, if they are few, and their buckets: nothing of the store is read."""
        some = [r.path for r in paths.select("path").distinct().limit(FEW + 1).collect()]
        if len(some) <= FEW:
            return some, sorted({self._bucket_of(p, manifest) for p in some if p is not None})
        found = paths.where("path IS NOT NULL").select(self._bucket(F.col("path"), manifest).alias("b")).distinct().collect()  # at most the number of buckets
        return None, sorted(r.b for r in found)

    def _divided(self, manifest: dict, bucket: int, chunks: int) -> None:
        """Split a bucket by as many bits as its chunks need."""
        now = [bucket]
        for _ in range(max(1, math.ceil(math.log2(chunks / self._split)))):
            manifest["split"] += now
            now = [b + (1 << b.bit_length() - 1) * k for b in now for k in (1, 2) if b.bit_length() <= DEPTH]

    # Writing -------------------------------------------------------------------------------

    def _write(self, chunks: DataFrame, manifest: dict, seq: int) -> dict[str, dict[str, list[int]]]:
        """Write chunks and their postings as a piece of each of their buckets; the new pieces by bucket."""
        piece = f"{seq:08d}{uuid.uuid4().hex[:16]}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = chunks.select(*CHUNK.names, self._bucket(F.col("path"), manifest).alias("bucket"), F.lit(piece).alias("piece"))
        rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "path", "start_line").write.mode("append").partitionBy("bucket", "piece").parquet(f"{self.path}/chunks")
        fs, make = self._fs()
        found = fs.globStatus(make(f"{self.path}/chunks/bucket=*/piece={piece}")) or []
        out = {s.getPath().getParent().getName().removeprefix("bucket="): {piece: [0, 0, 0]} for s in found}
        if not out:
            return out
        written = self._pieces("chunks", {"buckets": out, "gone": {}})
        terms = search.postings(written, keep=(*search.SLIM, "bucket")).withColumn("piece", F.lit(piece))
        terms.repartition(parts, "bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket", "piece").parquet(f"{self.path}/postings")
        for r in written.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(search.n_tokens(F.col("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars")).collect():  # a row for each bucket
            out[str(r.bucket)][piece] = [r.n, r.tokens or 0, r.chars or 0]
        return out

    def _bury(self, pairs: DataFrame, manifest: dict, seq: int) -> int:
        """Note in the manifest that the chunks of (path, branch) pairs, or of paths on all branches, do not count any more; how many chunks these are."""
        names, buckets = self._located(pairs, manifest)
        rows = self._pieces("chunks", manifest, buckets)
        if rows is None:
            return 0
        rows = (rows if names is None else rows.where(F.col("path").isin(names))).select("path", "branch", "bucket", search.n_tokens(F.col("text")).alias("tokens"), F.length("text").alias("chars"))
        same = F.col("r.path") == F.col("g.path")
        if "branch" in pairs.columns:
            same &= F.col("r.branch").eqNullSafe(F.col("g.branch"))
        hit = rows.alias("r").join(pairs.alias("g"), same, "left_semi")
        name = f"{seq:08d}{uuid.uuid4().hex[:16]}"
        found = hit.groupBy("path", "branch", "bucket").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
        found.select("path", "branch", F.lit(seq).alias("seq"), "bucket", "chunks", "tokens", "chars").write.parquet(f"{self.path}/gone/{name}")
        return self._listed([name], manifest)

    def _listed(self, names: list[str], manifest: dict) -> int:
        """Enter a list of pairs, of those buckets that the manifest has, with their sums; how many chunks it has."""
        pairs = self.spark.read.schema(PAIRS).parquet(*(f"{self.path}/gone/{n}" for n in names))
        sums = {str(r.bucket): [r.n, r.chunks, r.tokens, r.chars] for r in pairs.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("chunks", "tokens", "chars"))).collect()}  # a row for each bucket
        if sums:
            manifest["gone"][names[0]] = {"branch": None, "seq": 0, "buckets": sums}
        return sum(s[1] for s in sums.values())

    def _publish(self, manifest: dict, before: str | None) -> str:
        """Make a manifest the current version."""
        fs, make = self._fs()
        version = f"v{self._next(before):08d}"
        temp, target = make(f"{self.path}/manifests/.{uuid.uuid4().hex}"), make(f"{self.path}/manifests/{version}.json")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.version() != before or fs.exists(target) or not fs.rename(temp, target):
            raise RuntimeError("another writer has changed the store")
        self.clear_cache()
        return version

    def _change(self, new: DataFrame | None = None, pairs: DataFrame | None = None, branch: str | None = None) -> int:
        """One version in which pairs, or a branch, are gone and new is added; how many chunks went."""
        before = self.version()
        manifest = copy.deepcopy(self.manifest(before))
        seq = self._next(before)
        n = 0
        if pairs is not None:
            n = self._bury(pairs, manifest, seq)
        if branch is not None and (rows := self._pieces("chunks", manifest)) is not None:
            sums = rows.where(F.col("branch") == branch).groupBy("bucket").agg(F.count("*").alias("chunks"), F.sum(search.n_tokens(F.col("text"))).alias("tokens"), F.sum(F.length("text")).alias("chars")).collect()  # a row for each bucket
            n = sum(r.chunks for r in sums)
            if n:
                manifest["gone"][f"{seq:08d}-branch"] = {"branch": branch, "seq": seq, "buckets": {str(r.bucket): [0, r.chunks, r.tokens or 0, r.chars or 0] for r in sums}}
        added = self._write(with_ids(new), manifest, seq) if new is not None else {}
        for b, pieces in added.items():
            manifest["buckets"].setdefault(b, {}).update(pieces)
        if n or added:
            self._tidy(manifest, seq)
            self._note(manifest, self.manifest(before))
            self._publish(manifest, before)
        return n

    def _tidy(self, manifest: dict, seq: int) -> None:
        """Write anew what has too many pieces, too many chunks or too much that is gone."""
        lists = [name for name, g in manifest["gone"].items() if g["branch"] is None]
        if len(lists) > LISTS:
            name = f"{seq:08d}{uuid.uuid4().hex[:16]}"
            whole = self.spark.read.schema(PAIRS).parquet(*(f"{self.path}/gone/{x}" for x in lists))
            whole.where(F.col("bucket").isin([int(b) for b in manifest["buckets"]])).coalesce(1 + len(lists) // 64).write.parquet(f"{self.path}/gone/{name}")
            sums: dict[str, list[int]] = {}
            for x in lists:
                for b, s in manifest["gone"].pop(x)["buckets"].items():
                    sums[b] = [u + v for u, v in zip(sums[b], s, strict=False)] if b in sums else s
            if sums:
                manifest["gone"][name] = {"branch": None, "seq": 0, "buckets": sums}
        anew = []
        for b, pieces in manifest["buckets"].items():
            chunks, _, gone, pairs = self._held(manifest, b)
            large = chunks - gone > self._split and int(b).bit_length() <= DEPTH
            if large:
                self._divided(manifest, int(b), chunks - gone)
            if large or len(pieces) > PIECES or pairs > GONE or 2 * gone > chunks:
                anew.append(b)
        if anew:
            fresh = self._write(self._pieces("chunks", manifest, map(int, anew)), manifest, seq)
            for b in anew:
                del manifest["buckets"][b]
                for g in manifest["gone"].values():
                    g["buckets"].pop(b, None)
            manifest["buckets"] |= fresh
            manifest["gone"] = {name: g for name, g in manifest["gone"].items() if g["buckets"]}

    @staticmethod
    def _next(version: str | None) -> int:
        return int(version[1:]) + 1 if version else 1

    def commit(self, chunks: DataFrame) -> str:
        """Make chunks the whole content of the next version."""
        before = self.version()
        old = self.manifest(before)
        manifest = {"depth": old["depth"], "split": list(old["split"]), "buckets": {}, "gone": {}}
        manifest["buckets"] = self._write(chunks.select(*CHUNK.names), manifest, self._next(before))
        self._tidy(manifest, self._next(before))
        self._note(manifest, {})
        return self._publish(manifest, before)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions, and the pieces that none of these names."""
        fs, make = self._fs()
        names = [n for n in self._names("manifests") if n.startswith("v")]
        stay = names[-keep:] if keep else []
        kept = [self.manifest(n.removesuffix(".json")) for n in stay]
        used = {(b, p) for m in kept for b, pieces in m["buckets"].items() for p in pieces}
        for name in set(self._names("gone")) - {x for m in kept for x in m["gone"]}:
            fs.delete(make(f"{self.path}/gone/{name}"), True)
        for name in set(names) - set(stay):
            fs.delete(make(f"{self.path}/manifests/{name}"), False)
        for kind in ("chunks", "postings"):
            for folder in self._names(kind):
                for piece in self._names(f"{kind}/{folder}") if folder.startswith("bucket=") else []:
                    if (folder.removeprefix("bucket="), piece.removeprefix("piece=")) not in used:
                        fs.delete(make(f"{self.path}/{kind}/{folder}/{piece}"), True)

    # Changes -------------------------------------------------------------------------------

    def add(self, chunks: DataFrame) -> None:
        """Append chunks; without any nothing changes."""
        if chunks.head(1):
            self._change(chunks)

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows, written beside the store: what is costly to make is made once, and a lost executor costs a read."""
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_stage(self) -> None:
        fs, make = self._fs()
        fs.delete(make(f"{self.path}/staging"), True)

    def upsert(self, new: DataFrame | None, gone: DataFrame) -> None:
        """Replace the (path, branch) pairs in gone by the new chunks, in one version; new is computed once."""
        self._change(new, gone.select("path", "branch"))

    def delete_by_path(self, path: str) -> int:
        """Delete a path on all branches; the number of chunks that went.  What is written follows the path, not its bucket."""
        return self._change(pairs=self.spark.createDataFrame([(path,)], "path string"))

    def delete_by_branch(self, branch: str) -> int:
        """Delete what a branch has; the number of chunks that went.  Nothing but the manifest is written."""
        return self._change(branch=branch)

    def clear_all(self) -> None:
        fs, make = self._fs()
        fs.delete(make(self.path), True)
        self.clear_cache()

    # Questions -----------------------------------------------------------------------------

    def search(self, query_text: str | None = None, query_vector: Sequence[float] | None = None, limit: int = 10, mode: str | None = None, filters: Filters = Filters(), min_score: float | None = None, fts_weight: float = 0.5) -> DataFrame:
        index, about = self.index()
        return search.search(self.wide(), query_text, query_vector, limit, mode, filters, min_score, fts_weight, index, about)

    def cached(self, key: tuple, make) -> list[Row]:
        """Collected rows of a query on the current version; the oldest of many go."""
        key = (self.version(), *key)
        if key not in self._cache:
            self._cache[key] = make().collect()
            while len(self._cache) > CACHE_SIZE:
                self._cache.popitem(last=False)
        self._cache.move_to_end(key)
        return self._cache[key]

    def clear_cache(self) -> None:
        self._cache.clear()

    def count(self) -> int:
        return self._sums(self.manifest())[0]

    def file_hash(self, path: str, branch: str | None = None) -> str | None:
        found = self.wide(buckets=[self.bucket(path)]).where(F.col("path") == path)
        row = (found if branch is None else found.where(F.col("branch") == branch)).agg(F.min("file_hash").alias("h")).first()
        return row.h

    def stats(self) -> DataFrame:
        """The row of index_stats, from the manifest; by a scan if an earlier writer's pieces are not summed up in it."""
        manifest = self.manifest()
        about, chars = manifest.get("about", {}), [self._chars(manifest, b) for b in manifest["buckets"]]
        if None in chars or manifest["buckets"].keys() - about.keys():
            return stats.index_stats(self.chunks())
        languages: dict[str, int] = {}
        for _, _, mine in about.values():
            for language, n in mine.items():
                languages[language] = languages.get(language, 0) + n
        last = max((a[1] for a in about.values() if a[1] is not None), default=None)
        row = sum(a[0] for a in about.values()), sum(languages.values()), sum(chars), dict(sorted(languages.items())), last
        types = (T.LongType(), T.LongType(), T.LongType(), T.MapType(T.StringType(), T.LongType(), False), T.DoubleType())
        names = ("total_files", "total_chunks", "total_size_bytes", "languages", "last_indexed")
        return self.spark.createDataFrame([row], T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))

    def status(self) -> DataFrame:
        return stats.as_status(self.stats())

    def indexed_files(self, branch: str | None = None) -> DataFrame:
        return stats.indexed_files(self.chunks(), branch)


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with chunk_id, and in the order of the schema."""
    return chunks.withColumn("chunk_id", chunk_id(F.col("branch"), F.col("path"), F.col("chunk_seq"), F.col("file_hash"))).select(*CHUNK.names)
