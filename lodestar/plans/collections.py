"""Collections of vectors as tables: a log of committed batches, folded into generations, under tenants."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.payload import merge
from lodestar.functions.scoring import doubles, literal, score
from lodestar.operators import ann, payload_index, policy, state
from lodestar.operators.filters import Payload, check_ranges, compile_filter
from lodestar.operators.search import DimensionError, IndexCache, QueryCache
from lodestar.plans.spi import Observer, Searcher

LOG = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("norm", T.FloatType()), T.StructField("payload", T.StringType()),
])


class ValidationError(ValueError):
    """A request that can't be carried out (400)."""


class NotFound(KeyError):
    """No such collection or backup (404)."""


class QuotaExceeded(RuntimeError):
    """A tenant's limit would be passed (409)."""


class Conflict(RuntimeError):
    """Another writer committed first, again and again (409)."""


class DamagedPart(RuntimeError):
    """A generation that can't be read as it was written, and whose batches are gone."""


class Files:
    """Small files in any file system that Spark reaches; a rename makes a write visible."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> dict | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, path: str, value: dict, new: bool = False) -> bool:
        """Make the file in one step: at no time is there half of it. With new, False if it is there already, and it stays as it is."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE if new else rename.OVERWRITE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, how)
        except Py4JJavaError as e:
            fs.delete(tmp, False)
            if new and "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def move(self, source: str, target: str) -> None:
        (fs, p), (_, q) = self._at(source), self._at(target)
        fs.mkdirs(q.getParent())
        fs.rename(p, q)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        (a, p), (b, q) = self._at(source), self._at(target)
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self.spark.sparkContext._jsc.hadoopConfiguration()):
            raise OSError(f"can't copy {source}")


class Collection:
    """One collection. Each change writes a part, then commits it with the manifest of the next version, which only one writer can make.

    Readers see committed parts only. Parts that a change replaces stay for KEPT versions more, for readers that began before, and
    for recovery. Batches hold mutations as they came; generations hold whole records, sorted by sequence, with the values of promoted
    paths as typed columns.
    """

    KEPT, ATTEMPTS = 3, 8

    def __init__(self, db: Database, tenant: str, name: str, path: str | None = None):
        self.db, self.tenant, self.name, self.spark = db, tenant, name, db.spark
        self.path = path or db.path(tenant, name)
        self.cache = QueryCache()
        self.last_search: dict = {}

    @property
    def manifest(self) -> dict:
        names = [n for n in self.db.files.names(f"{self.path}/manifests") if n.endswith(".json")]
        m = self.db.files.read(f"{self.path}/manifests/{names[-1]}") if names else None
        if m is None:
            raise NotFound(f"no collection {self.name} of {self.tenant}")
        return m

    def _commit(self, m: dict, dropped: list[dict] = ()) -> bool:
        """Whether m has become the next version; dropped are parts that it no longer names."""
        m["version"] += 1
        m["garbage"] += [[p["name"], m["version"]] for p in dropped]
        old = [x for x in m["garbage"] if x[1] <= m["version"] - self.KEPT]
        m["garbage"] = [x for x in m["garbage"] if x not in old]
        if not self.db.files.write(f"{self.path}/manifests/{m['version']:020d}.json", m, new=True):
            return False
        for name, _ in old:
            self.db.files.delete(f"{self.path}/{name}")
        self.db.files.delete(f"{self.path}/manifests/{m['version'] - 4 * self.KEPT:020d}.json")
        return True

    #: Bytes of a part's file aimed at; a checksum is taken of whole files.
    FILE_BYTES = 256 << 20

    def _rows_per_file(self, dimension: int) -> int:
        return max(1, self.FILE_BYTES // (4 * dimension + 256))

    def _write(self, rows: DataFrame, name: str, m: dict, columns: list[str] = ()) -> dict:
        """Write rows as a part, and take its number of rows (in the same pass) and the digest of its files."""
        seen = Observation()
        rows = rows.select(*LOG.names, *([payload_index.fields(F.col("payload"), list(columns)).alias("fields")] if columns else []))
        counts = [F.count("*").alias("rows"), F.count_if(F.col("kind") == state.TOMBSTONE).alias("tombstones"), F.count_if(F.col("kind") == state.PATCH).alias("patches")]
        out = rows.observe(seen, *counts).write.option("maxRecordsPerFile", self._rows_per_file(m["dimension"]))
        # Filters of 64 KB let a lookup by id pass over the row groups without it.
        out.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.max.bytes", 64 << 10).parquet(f"{self.path}/{name}")
        return {"name": name, "columns": list(columns), "digest": self._digest(name), **seen.get}

    def _digest(self, name: str) -> list[int]:
        """The number of a part's files, and the digests of their bytes joined in any order."""
        files = self.spark.read.format("binaryFile").load(f"{self.path}/{name}").select(F.xxhash64("content", F.col("length")).alias("h"))
        return list(files.agg(F.count("*"), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.shiftright("h", 20)), F.lit(0))).first())

    def _read(self, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/{p['name']}" for p in parts)) if parts else self.spark.createDataFrame([], LOG)

    def log(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest
        return self._read(m["generations"] + m["batches"])

    @staticmethod
    def _folded(m: dict) -> bool:
        """Whether there is one part of live records only, which needs no folding."""
        return not m["batches"] and len(m["generations"]) == 1 and not m["generations"][0]["tombstones"]

    def state(self) -> DataFrame:
        return state.resolve(self.log())

    def live(self, m: dict | None = None) -> DataFrame:
        """(id, sequence, vector, norm, payload) of all live records."""
        m = m or self.manifest
        return self.log(m).drop("kind") if self._folded(m) else state.live(state.resolve(self.log(m)))

    def _alive(self, m: dict) -> DataFrame:
        """(id, sequence) of the newest live record of each id, patches aside: no vectors and payloads are read."""
        if self._folded(m):
            return self.log(m).select("id", "sequence")
        return state.versions(self.log(m)).where(~F.col("tombstone")).select("id", "sequence")

    def get(self, *ids: str) -> dict[str, dict]:
        """The live records of these ids, by id; bloom filters of the parts pass over those without them."""
        rows = state.live(state.resolve(self.log().where(F.col("id").isin([i.strip() for i in ids])))).collect()
        return {r.id: {"id": r.id, "sequence": r.sequence, "vector": r.vector, "payload": r.payload} for r in rows}

    def _append(self, make: Callable[[int], DataFrame], taken: int, mark: tuple[str, int] | None = None) -> dict | None:
        """Commit the rows that make gives for a base sequence, which uses taken sequences. If another writer was first, again on its version.

        mark: a stream and the number of its batch, committed with the rows; a batch that the stream has passed is left out.
        """
        for _ in range(self.ATTEMPTS):
            m = self.manifest
            if mark:
                if m["streams"].get(mark[0], -1) >= mark[1]:
                    return None
                m["streams"][mark[0]] = mark[1]
            part = self._write(make(m["sequence"]), f"batches/{m['sequence'] + 1:020d}-{uuid.uuid4().hex[:8]}", m)
            m["batches"].append(part)
            m["sequence"] += taken
            m["pending"] += taken
            if self._commit(m):
                self.db.observer.mutated(self, part["rows"])
                if self.db.auto:
                    self._maintain()
                return part
            self.db.files.delete(f"{self.path}/{part['name']}")
        raise Conflict(f"{self.name}: {self.ATTEMPTS} commits failed")

    def _debt(self, m: dict) -> tuple[int, int]:
        """Tombstones and replaced records among the pending mutations (at most: ids aren't compared)."""
        return sum(b["tombstones"] for b in m["batches"]), sum(b["patches"] for b in m["batches"])

    def _maintain(self) -> None:
        m = self.manifest
        tombstones, stale = self._debt(m)
        limit = policy.flush_bytes(m["flush_bytes"], m["pending"], m["pending"], tombstones, stale, m["dimension"])
        held = sum(self.db.files.size(f"{self.path}/{b['name']}") for b in m["batches"])
        if m["batches"] and (held >= limit or m["pending"] >= policy.flush_mutations(m["dimension"], m["pending"], tombstones, stale)):
            self.flush()
            s = self.stats()
            if policy.should_compact(s["segment_count"], False, s["persisted_tombstones"], s["persisted"] - s["live_vector_count"] - s["persisted_tombstones"], s["live_vector_count"], s["tombstone_count"]):
                self.compact()

    def upsert(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Add or replace rows (id, vector, payload as JSON text[, pos]); of an id that comes twice the last by pos stays. All or nothing.

        The rows are written once, with their places, before anything is counted or numbered; so input that comes out otherwise when it is
        computed again does no harm. Live ids are looked up only where a quota asks for them.
        """
        m, path = self.manifest, f"{self.path}/incoming/{uuid.uuid4().hex}"
        rows = rows.select(F.trim("id").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.coalesce("payload", F.lit("{}")).alias("payload"), F.col("pos") if "pos" in rows.columns else F.monotonically_increasing_id().alias("pos"))
        bad = F.coalesce(F.col("id") == "", F.lit(True)) | F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull())
        wrong = F.coalesce(F.size("vector") != m["dimension"], F.lit(True))
        seen = Observation()
        try:
            rows.observe(seen, F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(wrong).alias("wrong")).write.parquet(path)
            n = seen.get["n"]
            if not n:
                raise ValidationError("no vectors")
            if seen.get["bad"] or seen.get["wrong"]:
                raise ValidationError(f"{seen.get['bad']} rows without id or vector, {seen.get['wrong']} of another dimension than {m['dimension']}")
            own = self.spark.read.schema(rows.schema).parquet(path)
            if self.tenant in self.db.quotas:
                self.db.check_quota(self.tenant, rows=state.additional_live(own, self._alive(m)).first()[0], storage=self.db.files.size(path))
            v = F.col("vector").cast("array<double>")
            norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).cast("float")
            self._append(lambda base: state.numbered(own, base, "pos").select("id", "sequence", F.lit(state.LIVE).alias("kind"), "vector", norm.alias("norm"), "payload"), n, mark)
        finally:
            self.db.files.delete(path)
        return n

    def upsert_records(self, records) -> int:
        """records: dicts with id, vector and maybe payload."""
        data = [(r["id"], [float(x) for x in r["vector"]], json.dumps(r.get("payload") or {}, ensure_ascii=False, separators=(",", ":")), i) for i, r in enumerate(records)]
        if not data:
            raise ValidationError("no vectors")
        return self.upsert(self.spark.createDataFrame(data, "id string, vector array<float>, payload string, pos long"))

    def _known(self, ids) -> set[str]:
        m = self.manifest
        narrow = self.log(m).where(F.col("id").isin(list(ids)))
        return {r[0] for r in state.versions(narrow).where(~F.col("tombstone")).select("id").collect()}

    def delete(self, ids) -> int:
        """Delete a request's ids; unknown and deleted ones take no sequence."""
        wanted = list(dict.fromkeys(i.strip() for i in ids))
        if not wanted or "" in wanted:
            raise ValidationError("ids must be given and not blank")
        known = self._known(wanted)
        gone = [i for i in wanted if i in known]
        if gone:
            self._append(lambda base: self.spark.createDataFrame([(i, base + 1 + k, state.TOMBSTONE, None, None, None) for k, i in enumerate(gone)], LOG), len(gone))
        return len(gone)

    def delete_rows(self, ids: DataFrame) -> int:
        """Delete a table of ids, distributed."""
        path = f"{self.path}/incoming/{uuid.uuid4().hex}"
        try:
            ids.select(F.trim("id").alias("id")).distinct().join(self._alive(self.manifest).select("id"), "id", "left_semi").write.parquet(path)
            gone = self.spark.read.schema("id string").parquet(path)
            n = gone.count()
            none = lambda t: F.lit(None).cast(t)
            if n:
                self._append(lambda base: state.numbered(gone, base, "id").select("id", "sequence", F.lit(state.TOMBSTONE).alias("kind"), none("array<float>").alias("vector"), none("float").alias("norm"), none("string").alias("payload")), n)
        finally:
            self.db.files.delete(path)
        return n

    def partial_update(self, updates) -> int:
        """Merge payload patches [(id, patch)] of a request; patches of one id fold first, then each id must be live. All or nothing."""
        folded: dict[str, dict] = {}
        for record_id, patch in updates:
            record_id = record_id.strip()
            folded[record_id] = merge(folded[record_id], patch) if record_id in folded else dict(patch or {})
            if not folded[record_id]:
                raise ValidationError("payload must not be empty")
        known = self._known(folded)
        if missing := [i for i in folded if i not in known]:
            raise ValidationError(f"no live vector {missing[0]}")
        text = {i: json.dumps(p, ensure_ascii=False, separators=(",", ":")) for i, p in folded.items()}
        self._append(lambda base: self.spark.createDataFrame([(i, base + 1 + k, state.PATCH, None, None, p) for k, (i, p) in enumerate(text.items())], LOG), len(folded))
        return len(folded)

    def matching(self, m: dict, where: dict | None, mode: str = "compat") -> DataFrame:
        """Whole records (id, sequence, vector, norm) that pass the filter, of any version. Parts with promoted columns are read by these first."""
        groups: dict[tuple, list[dict]] = {}
        for p in m["generations"] + m["batches"]:
            groups.setdefault(tuple(p["columns"]), []).append(p)
        out = []
        for columns, parts in groups.items():
            paths = [f"{self.path}/{p['name']}" for p in parts]
            schema = LOG if not columns else T.StructType([*LOG.fields, T.StructField("fields", payload_index.fields_type(list(columns)))])
            rows = self.spark.read.schema(schema).parquet(*paths).where(F.col("kind") == state.LIVE)
            first = payload_index.implied(where, list(columns)) if columns and where else None
            rows = rows if first is None else rows.where(first)
            out.append((rows.where(compile_filter(where, Payload(F.parse_json("payload")), mode)) if where else rows).select("id", "sequence", "vector", "norm"))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], LOG).select("id", "sequence", "vector", "norm")

    def ranked(self, vector, k: int, where: dict | None = None, mode: str = "compat", m: dict | None = None) -> DataFrame:
        """(id, score, sequence) of the k best live rows by exact score.

        Scores are taken where the rows are read, and only (id, sequence, score) meet the latest versions; vectors never cross a shuffle. Ids
        with patches that no flush has folded yet are resolved by themselves.
        """
        m = m or self.manifest
        q, length = literal(vector), F.lit(sum(float(x) * float(x) for x in vector) ** 0.5)
        own = score(m["metric"], q, doubles(F.col("vector")), length, F.col("norm").cast("double")).alias("score")
        rows = self.matching(m, where, mode).select("id", "sequence", own)
        if not self._folded(m):
            rows = rows.join(self._alive(m), ["id", "sequence"], "left_semi")
        if any(b["patches"] for b in m["batches"]):
            log = self.log(m)
            patched = self._read([b for b in m["batches"] if b["patches"]]).where(F.col("kind") == state.PATCH).select("id").distinct()
            again = state.live(state.resolve(log.join(patched, "id", "left_semi")))
            again = again.where(compile_filter(where, Payload(F.parse_json("payload")), mode)) if where else again
            rows = rows.join(patched, "id", "left_anti").unionByName(again.select("id", "sequence", own))
        return rows.select("id", "score", "sequence").orderBy(F.desc("score"), F.desc("sequence"), F.asc("id")).limit(k)

    def search(self, vector, k: int, where: dict | None = None, mode: str = "compat", approximate: bool = False, searcher: Searcher | None = None, check_types: bool = False) -> list[dict]:
        """The k best live rows as dicts (id, score, payload, sequence); answers are remembered until the next change.

        check_types: a range over a path that holds values, but none of the bound's type, raises FilterError (a pass over the payloads);
        without it such a range is false.
        """
        m = self.manifest
        if len(vector) != m["dimension"]:
            raise DimensionError(f"a query of {len(vector)} for vectors of {m['dimension']}")
        if k <= 0:
            raise ValidationError("k must be positive")
        key = (tuple(vector), k, json.dumps(where, sort_keys=True), mode, approximate, type(searcher).__name__)
        began, self.last_search = time.time(), {"mode": "EXACT", "top_k": k}
        if check_types and where:
            check_ranges(self.log(m).where(F.col("kind") == state.LIVE), where, Payload(F.parse_json("payload")))

        def make():
            if searcher is not None:
                return searcher.search(self, vector, k, where, mode)
            return (approximate and self._approximate(m, vector, k, where, mode)) or self.exact(m, vector, k, where, mode)

        found, hit = self.cache.get(m["version"], key, make)
        took = time.time() - began
        self.last_search |= {"cache_hit": hit, "seconds": took, "slow": policy.is_slow(took)}
        self.db.observer.searched(self, self.last_search)
        return found

    def exact(self, m: dict, vector, k: int, where: dict | None, mode: str) -> list[dict]:
        """Rank without payloads, then look these up for the k survivors alone."""
        began = time.time()
        best = self.ranked(vector, k, where, mode, m).collect()
        middle = time.time()
        payloads = {i: x["payload"] for i, x in self.get(*(r.id for r in best)).items()} if best else {}
        self.last_search |= {"mode": "EXACT", "returned": len(best), "score_seconds": middle - began, "payload_seconds": time.time() - middle}
        return [{"id": r.id, "score": r.score, "payload": payloads.get(r.id), "sequence": r.sequence} for r in best]

    def _approximate(self, m: dict, vector, k: int, where: dict | None, mode: str) -> list[dict] | None:
        began = time.time()
        rows, graphs, books, n, hit = self.indexed()
        match = compile_filter(where, Payload(F.parse_json("payload")), mode) if where else None
        left = rows.where(match).count() if match is not None else None
        plan = policy.plan_search(n, k, left, n > policy.ANN_LEAST_ROWS)
        self.last_search |= {"mode": plan.mode, "total": n, "filtered": n if left is None else left, "beam": plan.beam, "rerank": plan.rerank, "index_cache_hit": hit}
        if plan.mode != "APPROXIMATE":
            return None
        middle = time.time()
        if graphs is not None and match is None:
            near = ann.search_graphs(graphs, vector, plan.beam, books, m["metric"])
            size = max(plan.rerank, plan.beam)
            best = near.orderBy(F.desc("approx"), "id").limit(size)
            found = [r.asDict() for r in ann.exact_topk(rows, best.select("id"), vector, k, m["metric"]).collect()]
            visited = near.agg(F.max("visited").alias("v")).first().v if self.db.trace else None
        else:
            found = [r.asDict() for r in ann.ann_topk(rows, vector, k, m["metric"], books, n, match, left).collect()]
            visited = n if left is None else left
        self.last_search |= {"scored": visited, "reranked": max(plan.rerank, plan.beam), "returned": len(found), "plan_seconds": middle - began, "search_seconds": time.time() - middle}
        return found

    #: Format of the index files; others are written anew.
    INDEX_FORMAT = 2

    def indexed(self) -> tuple[DataFrame, DataFrame | None, list, int, bool]:
        """Live rows with codes, stored graphs, codebooks, number of rows, and whether they were in the cache.

        They are written once for a version, and again where what is there doesn't fit (format, dimension, metric, number of rows). Rows that are
        too few for the approximate mode get neither codes nor graphs.
        """
        m, files = self.manifest, self.db.files
        path = f"{self.path}/index/{m['version']:020d}"
        made = files.read(f"{path}/index.json")
        if made is not None:
            rows = self.spark.read.parquet(f"{path}/rows")
            if (made.get("format"), made["dimension"], made["metric"]) != (self.INDEX_FORMAT, m["dimension"], m["metric"]) or rows.count() != made["count"]:
                made = None
        if made is None:
            self.evict()
            live = f"{path}/live"  # folded once, read by every round of training
            self.live(m).write.parquet(live)
            rows = self.spark.read.parquet(live)
            n = rows.count()
            books = ann.train(rows.select("sequence", "vector"), m["dimension"]) if n > policy.ANN_LEAST_ROWS else []
            (ann.with_codes(rows, books) if books else rows.withColumn("codes", F.lit(None).cast("array<tinyint>"))).write.parquet(f"{path}/rows")
            if books:
                ann.build_graphs(ann.sharded(rows.select("id", "sequence", "vector"), n), m["metric"], books).write.parquet(f"{path}/graphs")
            made = {"format": self.INDEX_FORMAT, "dimension": m["dimension"], "metric": m["metric"], "count": n, "books": [b.tolist() for b in books]}
            files.delete(live)
            files.write(f"{path}/index.json", made)

        def load():
            rows = self.spark.read.parquet(f"{path}/rows").persist()
            graphs = self.spark.read.parquet(f"{path}/graphs").persist() if made["books"] else None
            return [x for x in (rows, graphs) if x is not None]

        frames, hit = self.db.indexes.get(path, files.size(path), load)
        return frames[0], frames[1] if len(frames) > 1 else None, [np.array(b) for b in made["books"]], made["count"], hit

    def warm(self) -> None:
        self.indexed()

    def evict(self) -> None:
        self.db.indexes.drop(f"{self.path}/index/")
        self.db.files.delete(f"{self.path}/index")

    def close(self) -> None:
        """Give up what is cached; the files stay."""
        self.db.indexes.drop(f"{self.path}/index/")
        self.cache = QueryCache()

    def postings(self) -> DataFrame:
        """(path, value, id, sequence) of the live payloads of this version, sorted by path and value; written once."""
        m, files = self.manifest, self.db.files
        path = f"{self.path}/postings/{m['version']:020d}"
        if not files.exists(f"{path}/_SUCCESS"):
            files.delete(f"{self.path}/postings")
            posted = payload_index.postings(self.live(m), ["id", "sequence"])
            posted.repartitionByRange("path", "value").sortWithinPartitions("path", "value").write.option("parquet.bloom.filter.enabled#value", "true").parquet(path)
        return self.spark.read.parquet(path)

    def candidates(self, where: dict | None) -> int | None:
        """How many live rows the postings offer for a filter; None where they can't tell."""
        found = payload_index.candidates(self.postings(), where, ["id"])
        return None if found is None else found.count()

    def promote(self, *paths: str) -> None:
        """Keep the values of these payload paths as typed columns, in all generations written from now on (compact rewrites the older ones)."""
        for _ in range(self.ATTEMPTS):
            m = self.manifest
            m["columns"] = list(dict.fromkeys([*m["columns"], *paths]))
            if self._commit(m):
                return
        raise Conflict(f"{self.name}: {self.ATTEMPTS} commits failed")

    def _generation(self, rows: DataFrame, m: dict, size: int) -> dict | None:
        """Write rows as a generation, sorted by sequence; None (and nothing stays) if there are none."""
        name = f"generations/{m['next_generation']:020d}-{uuid.uuid4().hex[:8]}"
        m["next_generation"] += 1
        rows = rows.select(*LOG.names).repartitionByRange(max(1, -(-size // self._rows_per_file(m["dimension"]))), "sequence").sortWithinPartitions("sequence")
        part = self._write(rows, name, m, m["columns"])
        if part["rows"]:
            return part
        self.db.files.delete(f"{self.path}/{name}")
        return None

    def flush(self) -> bool:
        """Fold the batches since the last flush into one generation; tombstones stay, as older generations may hold the id."""
        for _ in range(self.ATTEMPTS):
            m = self.manifest
            if not m["batches"]:
                return False
            pending = self._read(m["batches"])
            if any(b["patches"] for b in m["batches"]):  # their records may stand in older generations
                pending = self.log(m).join(pending.select("id").distinct(), "id", "left_semi")
            rows = state.resolve(pending).withColumn("kind", F.when(F.col("tombstone"), state.TOMBSTONE).otherwise(state.LIVE))
            part, old = self._generation(rows, m, m["pending"]), m["batches"]
            m["generations"] += [part | {"batches": old}] if part else []
            m["batches"], m["pending"] = [], 0
            if self._commit(m, old):
                self.db.observer.flushed(self)
                return True
            if part:
                self.db.files.delete(f"{self.path}/{part['name']}")
        raise Conflict(f"{self.name}: {self.ATTEMPTS} commits failed")

    def compact(self) -> bool:
        """Rewrite two or more generations as one of live rows, or none; pending batches are flushed before."""
        self.flush()
        for _ in range(self.ATTEMPTS):
            m = self.manifest
            old = m["generations"]
            if len(old) < 2 and not any(g["tombstones"] or g["columns"] != m["columns"] for g in old):
                return False
            part = self._generation(state.live(state.resolve(self._read(old))).withColumn("kind", F.lit(state.LIVE)), m, sum(g["rows"] for g in old))
            m["generations"] = [part] if part else []
            if m["batches"]:  # written meanwhile; they come after what was compacted
                pass
            if self._commit(m, old):
                self.db.observer.compacted(self)
                return True
            if part:
                self.db.files.delete(f"{self.path}/{part['name']}")
        raise Conflict(f"{self.name}: {self.ATTEMPTS} commits failed")

    def sound(self, part: dict) -> bool:
        """Whether a part's files are byte by byte as they were written."""
        try:
            return self._digest(part["name"]) == part["digest"]
        except (PySparkException, Py4JJavaError):
            return False

    def recover(self) -> dict:
        """Check all parts; what is damaged goes to quarantine, and what no version names is deleted.

        A damaged generation is replaced by the batches it was made of, if these are still there and sound; else DamagedPart is
        raised and nothing is changed. The log of batches ends before the first damaged one.
        """
        m, files, changed = self.manifest, self.db.files, False
        moved, generations, batches = [], [], []
        for g in m["generations"]:
            if self.sound(g):
                generations.append(g)
                continue
            source = g.get("batches")
            if not source or not all(self.sound(b) for b in source):
                raise DamagedPart(f"{self.name}: {g['name']}")
            moved.append(g)
            batches += source
        tail = None
        for b in m["batches"]:
            if tail is None and not self.sound(b):
                tail = b["name"]
            (batches if tail is None else moved).append(b)
        if moved:
            back = {b["name"] for b in batches}
            m |= {"generations": generations, "batches": batches, "pending": sum(b["rows"] for b in batches), "garbage": [x for x in m["garbage"] if x[0] not in back]}
            changed = self._commit(m)
            for p in moved if changed else ():
                if files.exists(f"{self.path}/{p['name']}"):
                    files.move(f"{self.path}/{p['name']}", f"{self.path}/quarantine/{p['name']}")
        named = {p["name"] for p in m["generations"] + m["batches"]} | {x[0] for x in m["garbage"]}
        orphans = [f"{d}/{n}" for d in ("batches", "generations") for n in files.names(f"{self.path}/{d}") if f"{d}/{n}" not in named]
        for name in orphans:
            files.delete(f"{self.path}/{name}")
        files.delete(f"{self.path}/incoming")
        return {"recovered_tail": tail is not None, "quarantined": [p["name"] for p in moved], "orphans": orphans}

    def stats(self) -> dict:
        m = self.manifest
        if self._folded(m):
            live, dead = m["generations"][0]["rows"], 0
        else:
            c = state.counters(state.versions(self.log(m))).first()
            live, dead = c.live_vector_count, c.tombstone_count
        return {
            "name": self.name, "tenant_id": self.tenant, "dimension": m["dimension"], "metric": m["metric"], "live_vector_count": live, "tombstone_count": dead,
            "segment_count": len(m["generations"]), "flush_in_progress": False, "compaction_in_progress": False, "storage_bytes": self.db.files.size(self.path),
            "persisted": sum(g["rows"] for g in m["generations"]), "persisted_tombstones": sum(g["tombstones"] for g in m["generations"]),
        }

    def bulk_upsert(self, rows: DataFrame, flush: bool = False, compact: bool = False) -> int:
        """Upsert a table of any size in one commit; compact implies flush."""
        n = self.upsert(rows)
        if flush or compact:
            self.flush()
        if compact:
            self.compact()
        return n

    def bulk_load(self, source, mode: str = "JSON", flush: bool = False, compact: bool = False) -> int:
        """bulk_upsert of files: JSON bodies, JSON lines (NDJSON) or binary streams (BINARY)."""
        from lodestar.sources import codecs

        read = {"JSON": codecs.read_body, "NDJSON": codecs.read_lines, "BINARY": lambda s, p: codecs.read_binary(s, p, self.manifest["dimension"])}
        if mode not in read:
            raise ValidationError(f"mode {mode!r}; one of {sorted(read)}")
        return self.bulk_upsert(read[mode](self.spark, source), flush, compact)

    def synchronize(self, upserts=(), patches=(), deletes=(), flush: bool = False, compact: bool = False) -> dict:
        """Upserts, then patches, then deletes, then flush and compact."""
        done = {"upserted": self.upsert_records(upserts) if upserts else 0, "patched": self.partial_update(patches) if patches else 0, "deleted": self.delete(deletes) if deletes else 0}
        done["flushed"] = bool(flush or compact) and self.flush()
        done["compacted"] = bool(compact) and self.compact()
        return done


class Database:
    """Tenants and their collections and backups under one root."""

    def __init__(self, spark: SparkSession, root: str, auto: bool = False, quotas: dict[str, policy.Quota] | None = None, observer: Observer | None = None, trace: bool = False):
        self.spark, self.root, self.auto, self.quotas, self.trace = spark, root.rstrip("/"), auto, quotas or {}, trace
        self.files, self.indexes, self.observer = Files(spark), IndexCache(), observer or Observer()

    def path(self, tenant: str, name: str) -> str:
        return f"{self.root}/tenant_id={policy.checked_name(tenant, 'tenant')}/collection={policy.checked_name(name)}"

    def create(self, name: str, dimension: int, metric: str | None = None, tenant: str = policy.DEFAULT_TENANT, flush_bytes: int | None = None, columns=()) -> Collection:
        """A new collection; columns are payload paths whose values are kept as typed columns, which filters are pushed down to."""
        path, metric = self.path(tenant, name), metric or "COSINE"
        if dimension <= 0 or metric not in ("COSINE", "L2") or (flush_bytes is not None and flush_bytes <= 0):
            raise ValidationError("dimension and flush_bytes must be positive, metric COSINE or L2")
        if self.files.names(f"{path}/manifests"):
            raise ValidationError(f"collection {name} exists already")
        self.check_quota(tenant, collections=1)
        first = {"dimension": dimension, "metric": metric, "flush_bytes": flush_bytes or policy.DEFAULT_FLUSH_BYTES, "version": 0, "sequence": 0, "pending": 0, "next_generation": 1, "generations": [], "batches": [], "garbage": [], "streams": {}, "columns": list(columns), "created_at": time.time()}
        if not self.files.write(f"{path}/manifests/{0:020d}.json", first, new=True):
            raise ValidationError(f"collection {name} exists already")
        return Collection(self, tenant, name)

    def open(self, name: str, tenant: str = policy.DEFAULT_TENANT, recover: bool = False) -> Collection:
        """The collection of that name; with recover, its parts are checked first (see Collection.recover)."""
        c = Collection(self, tenant, name)
        c.manifest  # noqa: B018  raises where there is none
        if recover:
            c.recovered = c.recover()
        return c

    def load_for_serving(self, name: str, dimension: int, rows: DataFrame, metric: str | None = None, tenant: str = policy.DEFAULT_TENANT, compact: bool = False) -> Collection:
        """Make sure that the collection is there, upsert the rows, flush, and maybe compact."""
        c = self.ensure(name, dimension, metric, tenant)
        c.bulk_upsert(rows, flush=True, compact=compact)
        return c

    def warm(self, budget: int = 256 << 20) -> list[str]:
        """Warm the indexes of collections, small ones first, as far as the budget goes; what is warm."""
        done, used = [], 0
        for c in sorted(self.collections(), key=lambda c: self.files.size(c.path)):
            used += self.files.size(c.path)
            if used > budget:
                break
            c.warm()
            done.append(f"{c.tenant}/{c.name}")
        return done

    def close(self) -> None:
        self.indexes.drop("")

    def ensure(self, name: str, dimension: int, metric: str | None = None, tenant: str = policy.DEFAULT_TENANT) -> Collection:
        try:
            return self.create(name, dimension, metric, tenant)
        except ValidationError:
            m = self.open(name, tenant).manifest
            if (m["dimension"], m["metric"]) != (dimension, metric or "COSINE"):
                raise
            return self.open(name, tenant)

    def collections(self, tenant: str | None = None) -> list[Collection]:
        """By tenant, then name."""
        names = [tenant] if tenant else [n.removeprefix("tenant_id=") for n in self.files.names(self.root) if n.startswith("tenant_id=")]
        return [Collection(self, t, n.removeprefix("collection=")) for t in sorted(names) for n in self.files.names(f"{self.root}/tenant_id={t}") if n.startswith("collection=") and self.files.names(f"{self.root}/tenant_id={t}/{n}/manifests")]

    def list_collections(self, tenant: str | None = None) -> list[dict]:
        """The stats of each collection, by tenant, then name."""
        return [c.stats() for c in self.collections(tenant)]

    def tenants(self) -> list[str]:
        return sorted({c.tenant for c in self.collections()} | set(self.quotas)) or [policy.DEFAULT_TENANT]

    def tenant_stats(self, tenant: str) -> dict:
        s = [c.stats() for c in self.collections(tenant)]
        b = self.backups(tenant)
        return {"tenant_id": tenant, "collection_count": len(s), "backup_count": len(b), "last_backup": max((x["created_at"] for x in b), default=None)} | {k: sum(x[k] for x in s) for k in ("live_vector_count", "tombstone_count", "segment_count", "storage_bytes")}

    def check_quota(self, tenant: str, collections: int = 0, rows: int = 0, storage: int = 0) -> None:
        if q := self.quotas.get(tenant):
            s = self.tenant_stats(tenant)
            if said := q.exceeded(s["collection_count"] + collections, s["live_vector_count"] + rows, s["storage_bytes"] + storage):
                raise QuotaExceeded(f"{tenant}: {said}")

    def backup(self, name: str, backup_id: str, tenant: str = policy.DEFAULT_TENANT) -> dict:
        c, target = self.open(name, tenant), f"{self.root}/backups/{policy.checked_name(tenant)}/{policy.checked_name(name)}/{policy.checked_name(backup_id, 'backup')}"
        if self.files.exists(target):
            raise ValidationError(f"backup {backup_id} exists already")
        before = c.manifest["version"]
        self.files.copy(f"{c.path}/manifests", f"{target}/data/manifests")
        for part in c.manifest["generations"] + c.manifest["batches"]:
            self.files.copy(f"{c.path}/{part['name']}", f"{target}/data/{part['name']}")
        if c.manifest["version"] != before:  # a backup is of one version
            self.files.delete(target)
            raise ValidationError(f"collection {name} changed while it was copied")
        made = {"backup_id": backup_id, "tenant_id": tenant, "name": name, "created_at": time.time(), "sequence": c.manifest["sequence"], "stats": c.stats()}
        self.files.write(f"{target}/backup.json", made)
        return made

    def backups(self, tenant: str | None = None, backup_id: str | None = None) -> list[dict]:
        """Newest first, then by tenant and name."""
        root = f"{self.root}/backups"
        found = [self.files.read(f"{root}/{t}/{n}/{b}/backup.json") for t in self.files.names(root) if tenant in (None, t) for n in self.files.names(f"{root}/{t}") for b in self.files.names(f"{root}/{t}/{n}") if backup_id in (None, b)]
        return sorted((x for x in found if x), key=lambda x: (-x["created_at"], x["tenant_id"], x["name"]))

    def preview(self, name: str, backup_id: str, tenant: str = policy.DEFAULT_TENANT) -> dict:
        """Stats of a backup, folded from its own files without restoring it."""
        data = f"{self.root}/backups/{policy.checked_name(tenant)}/{policy.checked_name(name)}/{policy.checked_name(backup_id, 'backup')}/data"
        if not self.files.exists(data):
            raise NotFound(f"no backup {backup_id} of {name}")
        return Collection(self, tenant, name, data).stats()

    def restore(self, name: str, backup_id: str, target: str, tenant: str = policy.DEFAULT_TENANT) -> Collection:
        source = f"{self.root}/backups/{policy.checked_name(tenant)}/{policy.checked_name(name)}/{policy.checked_name(backup_id, 'backup')}/data"
        if not self.files.exists(source):
            raise NotFound(f"no backup {backup_id} of {name}")
        if self.files.names(f"{self.path(tenant, target)}/manifests"):
            raise ValidationError(f"collection {target} exists already")
        self.check_quota(tenant, collections=1)
        self.files.copy(source, self.path(tenant, target))
        return self.open(target, tenant)

    def snapshot_tenant(self, tenant: str, backup_id: str) -> list[dict]:
        """Flush and back up every collection of a tenant; if one fails, none of these backups stays."""
        done: list[dict] = []
        try:
            for c in self.collections(tenant):
                c.flush()
                done.append(self.backup(c.name, backup_id, tenant))
        except Exception:
            for b in done:
                self.files.delete(f"{self.root}/backups/{tenant}/{b['name']}/{backup_id}")
            raise
        return done

    def scheduled_snapshot(self, tenant: str, keep: int) -> list[str]:
        """Back up the collections that changed since their last automatic backup, then keep the newest of these; the new ids."""
        done = []
        for c in self.collections(tenant):
            prefix = f"auto-{tenant}-{c.name}-"
            last = next((b for b in self.backups(tenant) if b["name"] == c.name and b["backup_id"].startswith(prefix)), None)
            if last is None or last["sequence"] != c.manifest["sequence"]:
                c.flush()
                done.append(self.backup(c.name, prefix + time.strftime("%Y%m%d%H%M%S", time.gmtime()), tenant)["backup_id"])
                self.prune_backups(tenant, c.name, keep)
        return done

    def prune_backups(self, tenant: str, name: str, keep: int) -> list[str]:
        """Delete all but the newest keep automatic backups; their ids."""
        old = [b for b in self.backups(tenant) if b["name"] == name and b["backup_id"].startswith(f"auto-{tenant}-{name}-")][keep:]
        for b in old:
            self.files.delete(f"{self.root}/backups/{tenant}/{name}/{b['backup_id']}")
        return [b["backup_id"] for b in old]


def retained(backups: DataFrame, keep: int) -> DataFrame:
    """Of (tenant_id, name, backup_id, created_at) those that retention deletes."""
    w = Window.partitionBy("tenant_id", "name").orderBy(F.desc("created_at"), F.desc("backup_id"))
    return backups.withColumn("place", F.row_number().over(w)).where(F.col("place") > keep).drop("place")
