"""A store of tables in levels: a change is written as a run of its own, reads merge the runs, and runs of a size are merged by and by.

A run holds new rows and the owners (documents, say) whose older rows it replaces. A row counts unless a later run replaces its
owner; so a change of a thousand documents writes a thousand documents, whatever the size of the store. As soon as `fanout` runs of
about the same size stand at the end of a table, they become one, and each row is rewritten once a level. A run's rows lie in
2**bits buckets of the hash of the table's keys, as many as its size asks for: when runs grow together their buckets split, and a
bucket of a run with fewer bits holds that of one with more.

A manifest names the runs of all tables. A change of several tables counts once its manifest is there, all of it or nothing; the folders that
it is about to write are named in an intent first, so what a killed writer leaves behind can be told and deleted. Two writers at a
time: the later one adds its runs to what the other has committed, and starts again where both replaced rows of the same owner.

Rules, unique keys and references are checked for the rows of a change before it is committed. Whether a value is anywhere in a
table is asked of a filter, a bitmap of hashes for each bucket, and only the buckets that may have it are read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that deals rows to buckets, in the folders' names only, and the run's place among those of its table while they are merged.
BUCKET, RUN = "__bucket", "__run"
#: Bits of the hash of a value in a filter, and of those the ones within a page of a bitmap.
FILTER_BITS, PAGE = 20, 32768


class Refused(ValueError):
    """A change whose rows break a rule, a unique key or a reference. rows: some of them."""

    def __init__(self, message: str, rows: list):
        super().__init__(f"{message}: {rows}")
        self.rows = rows


@dataclass(frozen=True)
class Table:
    """schema: its columns. keys: whose hash deals rows to buckets. owner: the columns by which rows are replaced; keys unless given.
    filters: columns that are asked for by value; ranges: numbers and times that are asked for by their least and greatest value. unique: keys that no two rows share, nulls aside; those beyond the owner have a filter.
    rules: conditions that each row meets, by name. references: column, table and column that it names. cascades: tables and
    their columns that name this table's first unique column, and whose rows go with it."""

    schema: str
    keys: tuple[str, ...] = ()
    owner: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    ranges: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    rules: Callable[[], Mapping[str, Column]] | None = None
    references: tuple[tuple[str, str, str], ...] = ()
    cascades: tuple[tuple[str, str], ...] = ()

    def owners(self) -> tuple[str, ...]:
        return self.owner or self.keys

    def filtered(self) -> list[str]:
        own = self.owners()
        return list(dict.fromkeys([*self.filters, *(u[0] for u in self.unique if not set(own) <= set(u))]))


@dataclass(frozen=True)
class Change:
    """Replaces the rows of owners in a table: make takes those that are there and gives the new ones, whose owners must be among these."""

    table: str
    owners: DataFrame
    make: Callable[[DataFrame], DataFrame]


@dataclass
class State:
    """A manifest: by table its runs, the oldest first; each has id, rows, bits, buckets and whether it replaces any owner."""

    number: int
    runs: dict[str, list[dict]] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table | str], bucket_rows: int = 1 << 16, fanout: int = 4, keep: int = 2, level_rows: int = 1024):
        """bucket_rows: rows of a bucket at most, on average. keep: states that stay for those who still read them. level_rows: a run
        of fewer rows is of the lowest level."""
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {n: t if isinstance(t, Table) else Table(t) for n, t in tables.items()}
        self.bucket_rows, self.fanout, self.keep, self.level_rows = max(1, bucket_rows), max(2, fanout), max(1, keep), max(1, level_rows)

    # Files.

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        files, where = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def _delete(self, path: str) -> None:
        files, where = self._at(path)
        files.delete(where, True)

    def _text(self, path: str) -> str:
        files, where = self._at(path)
        source = files.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _put(self, path: str, text: str) -> bool:
        """Whether this has become the file; no, if there is one already."""
        files, to = self._at(path)
        _, by = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        out = files.create(by, True)
        out.write(bytearray(text.encode()))
        out.close()
        done = not files.exists(to) and (files.mkdirs(to.getParent()) and files.rename(by, to))
        if not done:
            files.delete(by, False)
        return done

    # States.

    def versions(self) -> list[int]:
        """Numbers of the states that are there, in order."""
        return sorted(int(n[6:-5]) for n in self._names(f"{self.path}/manifest") if re.fullmatch(r"state-\d+\.json", n))

    def state(self, number: int | None = None) -> State:
        found = self.versions()
        if not found and number is None:
            return State(0)
        number = found[-1] if number is None else number
        return State(number, json.loads(self._text(f"{self.path}/manifest/state-{number:09d}.json")))

    def _commit(self, number: int, runs: dict[str, list[dict]]) -> bool:
        done = self._put(f"{self.path}/manifest/state-{number:09d}.json", json.dumps(runs))
        if done:
            self._forget()
        return done

    def _forget(self) -> None:
        """Drops all but the last `keep` states, and the runs that only those had."""
        found = self.versions()
        ids = lambda n: {(t, r["id"]) for t, runs in self.state(n).runs.items() for r in runs}
        old = found[: -self.keep]
        held = set().union(*(ids(n) for n in found[-self.keep :])) if old else set()
        for n in old:
            for table, run in ids(n) - held:
                self._delete(self._folder(table, run))
            self._delete(f"{self.path}/manifest/state-{n:09d}.json")

    def recover(self, older_than: float = 86400.0) -> list[str]:
        """Deletes what writers left that were killed, judged by the age of their intents in seconds; returns the folders."""
        held = {(t, r["id"]) for n in self.versions() for t, runs in self.state(n).runs.items() for r in runs}
        gone = []
        for name in self._names(f"{self.path}/intents"):
            told = json.loads(self._text(f"{self.path}/intents/{name}"))
            if time.time() - told["time"] < older_than:
                continue
            for table, run in told["runs"]:
                if (table, run) not in held and self._names(self._folder(table, run)):
                    self._delete(self._folder(table, run))
                    gone.append(self._folder(table, run))
            self._delete(f"{self.path}/intents/{name}")
        return gone

    # Reading.

    def _folder(self, table: str, run: str) -> str:
        return f"{self.path}/data/{table}/{run}"

    def _hash(self, columns: Sequence[str], bits: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(1 << bits)).cast("int") if columns and bits else F.lit(0)

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[table].schema)

    def _rows(self, table: str, run: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """A run's rows, those of some buckets if given (numbers by the run's own bits)."""
        some = [b for b in run["buckets"] if buckets is None or b in buckets]
        at = self._folder(table, run["id"])
        return self.spark.read.schema(self.tables[table].schema).parquet(*[f"{at}/rows/{BUCKET}={b}" for b in some]) if some else None

    def _live(self, table: str, runs: list[dict], buckets: Callable[[dict], set[int] | None] = lambda _: None) -> DataFrame:
        """The rows that count. What later runs replace is a small table beside the rows, so Spark can send it to them."""
        owner = list(self.tables[table].owners())
        parts = [(i, rows) for i, r in enumerate(runs) if (rows := self._rows(table, r, buckets(r))) is not None]
        if not parts:
            return self._empty(table)
        after = [(i, r) for i, r in enumerate(runs) if r["replaces"] and i > parts[0][0]]
        whole = reduce(DataFrame.unionByName, [rows.withColumn(RUN, F.lit(i)) for i, rows in parts])
        if after:
            kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._empty(table).select(*owner).schema)
            gone = reduce(DataFrame.unionByName, [self.spark.read.schema(kind).parquet(f"{self._folder(table, r['id'])}/gone").withColumn("__last", F.lit(i)) for i, r in after])
            gone = gone.groupBy(*[F.col(c).alias(f"__{c}") for c in owner]).agg(F.max("__last").alias("__last"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in owner]
            whole = whole.join(gone, reduce(Column.__and__, [*same, F.col(RUN) < F.col("__last")]), "left_anti")
        return whole.drop(RUN)

    def _touched(self, table: str, runs: list[dict], keys: DataFrame) -> Callable[[dict], set[int] | None]:
        """The buckets of each run that the keys fall in: as many numbers at most as the largest run has buckets."""
        bits = max((r["bits"] for r in runs), default=0)
        if not bits:
            return lambda _: None
        found = [r[0] for r in keys.select(self._hash(self.tables[table].keys, bits).alias("b")).distinct().collect()]
        return lambda run: {b & (1 << run["bits"]) - 1 for b in found}

    def read(self, table: str, version: int | None = None, keys: DataFrame | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
        """A table; the rows with some keys, or with values of filtered columns, from the buckets that may have them."""
        return self._read(table, self.state(version).runs.get(table, []), keys, where)

    def _read(self, table: str, runs: list[dict], keys: DataFrame | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
        if keys is not None:
            own = list(self.tables[table].keys)
            names = keys.select(*own).distinct().withColumnsRenamed({c: f"__{c}" for c in own})
            rows = self._live(table, runs, self._touched(table, runs, keys))
            return rows.join(names, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own]), "left_semi")
        if where:
            kinds = {f.name: f.dataType for f in self._empty(table).schema}
            found, met = [], []
            for c, v in where.items():
                if isinstance(v, tuple):
                    found.append(self._may_lie(table, runs, c, *v))
                    met.append(F.col(c).between(*[F.lit(x).cast(kinds[c]) for x in v]))
                else:
                    found.append(self._may_have(table, runs, c, self.spark.range(1).select(F.lit(v).cast(kinds[c]).alias(c))))
                    met.append(F.col(c) == F.lit(v))
            rows = self._live(table, runs, lambda r: set.intersection(*(f.get(r["id"], set()) for f in found)))
            return rows.where(reduce(Column.__and__, met))
        return self._live(table, runs)

    def _may_have(self, table: str, runs: list[dict], column: str, values: DataFrame) -> dict[str, set[int]]:
        """By run the buckets whose filter has one of the values; all of a run's that has no filter."""
        out = {r["id"]: set(r["buckets"]) for r in runs if column not in r["filters"]}
        paths = [f"{self._folder(table, r['id'])}/filters" for r in runs if column in r["filters"] and r["buckets"]]
        if not paths:
            return out
        at = values.where(F.col(column).isNotNull()).select((F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)) + 1).alias("at")).distinct()
        at = at.select(F.bitmap_bucket_number("at").alias("page"), F.bitmap_bit_position("at").cast("int").alias("bit"))
        maps = self.spark.read.schema(FILTERS).parquet(*paths).where((F.col("column") == column) & (F.col("page") > 0))
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = maps.join(at, "page").withColumn("byte", byte).where(F.expr("(byte & shiftleft(1, cast(bit % 8 as int))) != 0"))
        for r in hit.select("run", "bucket").distinct().collect():
            out.setdefault(r["run"], set()).add(r["bucket"])
        return out

    def _may_lie(self, table: str, runs: list[dict], column: str, low: object, high: object) -> dict[str, set[int]]:
        """By run the buckets whose least and greatest values of a column leave room for a range; all of a run's that has none."""
        out = {r["id"]: set(r["buckets"]) for r in runs if column not in r["filters"]}
        paths = [f"{self._folder(table, r['id'])}/filters" for r in runs if column in r["filters"] and r["buckets"]]
        if paths:
            kind = self._empty(table).schema[column].dataType
            x, y = (_number(F.lit(v).cast(kind), kind.simpleString()) for v in (low, high))
            maps = self.spark.read.schema(FILTERS).parquet(*paths).where((F.col("column") == column) & (F.col("page") == 0))
            for r in maps.where((F.col("least") <= y) & (F.col("greatest") >= x)).select("run", "bucket").distinct().collect():
                out.setdefault(r["run"], set()).add(r["bucket"])
        return out

    # Writing.

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Makes df the whole of a table; columns in the order of the schema, missing ones null."""
        while True:
            now = self.state()
            run = self._run(table, df, None)
            self._check(table, [], run, {})
            if self._commit(now.number + 1, now.runs | {table: [run] if run["rows"] else []}):
                return self.read(table)
            self._delete(self._folder(table, run["id"]))

    def update(self, table: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        self.apply([Change(table, keys, change)])
        return self.read(table)

    def apply(self, changes: Sequence[Change], prepared: Callable[[], None] | None = None) -> None:
        """Makes all the changes, one after the other, or none; each sees those before it. Refused if a row breaks what its table asks
        for. prepared is called before the commit, for tests."""
        while True:
            before = self.state()
            intent = f"{self.path}/intents/{uuid.uuid4().hex}.json"
            planned = [(c.table, uuid.uuid4().hex) for c in changes]
            planned += [(t, uuid.uuid4().hex) for c in changes for t, _ in self.tables[c.table].cascades]
            self._put(intent, json.dumps({"time": time.time(), "runs": planned}))
            mine: dict[str, list[dict]] = {}
            ids = {t: [i for x, i in planned if x == t] for t, _ in planned}
            try:
                for c in changes:
                    self._one(c, before, mine, ids)
                for table, runs in mine.items():
                    for run in runs:
                        self._check(table, before.runs.get(table, []), run, mine, before)
            except BaseException:
                self._drop(mine, intent)
                raise
            if prepared:
                prepared()
            while True:
                now = self.state()
                if self._met(before, now, mine):
                    self._drop(mine, intent)
                    break  # another writer has replaced rows of the same owners: once more, from what it left
                if self._commit(now.number + 1, now.runs | {t: [*now.runs.get(t, []), *runs] for t, runs in mine.items()}):
                    self._delete(intent)
                    for table in mine:
                        self.compact(table)
                    return

    def _drop(self, mine: dict[str, list[dict]], intent: str) -> None:
        for table, runs in mine.items():
            for run in runs:
                self._delete(self._folder(table, run["id"]))
        self._delete(intent)

    def _one(self, c: Change, before: State, mine: dict[str, list[dict]], ids: dict[str, list[str]]) -> None:
        spec = self.tables[c.table]
        owner = list(spec.owners())
        owners = c.owners.select(*owner).distinct()
        runs = [*before.runs.get(c.table, []), *mine.get(c.table, [])]
        # Rows lie in buckets of their keys; where owners are something else, all buckets may have some.
        by_key = owner == list(spec.keys)
        old = self._read(c.table, runs, owners) if by_key else self._live(c.table, runs).join(owners, owner, "left_semi")
        run = self._run(c.table, c.make(old), owners, ids[c.table].pop())
        beyond = self._rows(c.table, run)
        if beyond is not None and not (bad := beyond.select(*owner).join(owners, reduce(Column.__and__, [beyond[x].eqNullSafe(owners[x]) for x in owner]), "left_anti").limit(3)).isEmpty():
            rows = bad.collect()
            self._delete(self._folder(c.table, run["id"]))
            raise Refused(f"rows of owners in {c.table} that weren't asked for", rows)
        mine.setdefault(c.table, []).append(run)
        if spec.cascades and before.runs.get(c.table):
            parent = spec.unique[0][0]
            left = old.select(parent).distinct() if beyond is None else old.select(parent).distinct().join(beyond.select(parent), parent, "left_anti")
            if not left.isEmpty():
                for child, column in spec.cascades:
                    self._one(Change(child, left.select(F.col(parent).alias(column)), lambda rows: rows.where("false")), before, mine, ids)

    def _run(self, table: str, df: DataFrame, owners: DataFrame | None, run: str | None = None) -> dict:
        """Writes a run. A small one is one bucket; a larger one is dealt out once its size is known."""
        spec, run, empty = self.tables[table], run or uuid.uuid4().hex, self._empty(table)
        at = self._folder(table, run)
        whole = empty.unionByName(df.select(*[c for c in empty.columns if c in df.columns]), allowMissingColumns=True)
        order = list(dict.fromkeys([*spec.keys, *spec.owners()]))
        sort = lambda x, *first: x.sortWithinPartitions(*first, *order) if order else x
        sort(whole.hint("rebalance")).write.parquet(f"{at}/rows/{BUCKET}=0")
        n = self.spark.read.schema(spec.schema).parquet(f"{at}/rows/{BUCKET}=0").count()
        bits = max(0, (-(-n // self.bucket_rows) - 1).bit_length()) if spec.keys else 0
        if bits:
            rows = self.spark.read.schema(spec.schema).parquet(f"{at}/rows/{BUCKET}=0").withColumn(BUCKET, self._hash(spec.keys, bits))
            sort(rows.hint("rebalance", BUCKET), BUCKET).write.partitionBy(BUCKET).parquet(f"{at}/dealt")
            files, was = self._at(f"{at}/rows")
            files.delete(was, True)
            files.rename(self._at(f"{at}/dealt")[1], was)
        if owners is not None:
            owners.write.parquet(f"{at}/gone")
        buckets = sorted(int(x.split("=")[1]) for x in self._names(f"{at}/rows") if x.startswith(f"{BUCKET}=")) if n else []
        out = {"id": run, "rows": n, "bits": bits, "buckets": buckets, "replaces": owners is not None, "filters": [*spec.filtered(), *spec.ranges] if n else []}
        if out["filters"]:
            self._filters(table, out)
        return out

    def _filters(self, table: str, run: dict) -> None:
        """For each bucket and filtered column the pages, from 1, of a bitmap of its values' hashes; for each range, as page 0, its ends."""
        spec = self.tables[table]
        rows = self._rows(table, run).withColumn("bucket", self._hash(spec.keys, run["bits"]))
        kinds, none = dict(rows.dtypes), F.lit(None).cast("long")
        each = [F.struct(F.lit(c).alias("column"), F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)) + 1).alias("at"), none.alias("number")) for c in spec.filtered()]
        each += [F.struct(F.lit(c).alias("column"), none.alias("at"), _number(F.col(c), kinds[c]).alias("number")) for c in spec.ranges]
        at = rows.select("bucket", F.explode(F.array(*each)).alias("x")).select("bucket", "x.*").where("at is not null or number is not null")
        page = F.coalesce(F.bitmap_bucket_number("at"), F.lit(0)).alias("page")
        maps = at.groupBy("bucket", "column", page).agg(F.bitmap_construct_agg(F.coalesce(F.bitmap_bit_position("at"), F.lit(0))).alias("bits"), F.min("number").alias("least"), F.max("number").alias("greatest"))
        maps.select(F.lit(run["id"]).alias("run"), "bucket", "column", "page", "bits", "least", "greatest").hint("rebalance").write.parquet(f"{self._folder(table, run['id'])}/filters")

    def _met(self, before: State, now: State, mine: dict[str, list[dict]]) -> bool:
        """Whether others have replaced rows of the owners that I replace, or merged runs that I need, since I began."""
        for table, runs in mine.items():
            old = {r["id"] for r in before.runs.get(table, [])}
            new = [r for r in now.runs.get(table, []) if r["id"] not in old and not r.get("merged")]
            owner = list(self.tables[table].owners())
            gone = lambda r: self.spark.read.parquet(f"{self._folder(table, r['id'])}/gone").select(*owner)
            if any(not r["replaces"] for r in new):
                return True  # the whole table was written
            if new and not reduce(DataFrame.union, map(gone, new)).join(reduce(DataFrame.union, [gone(r) for r in runs]), owner, "left_semi").isEmpty():
                return True
        return False

    # Merging.

    def _level(self, run: dict) -> int:
        level, size = 0, self.level_rows
        while run["rows"] >= size:
            level, size = level + 1, size * self.fanout
        return level

    def compact(self, table: str) -> None:
        """Merges runs at the end of a table while `fanout` of them or more are of no greater level than the last of these."""
        while True:
            now = self.state()
            runs = now.runs.get(table, [])
            start = next((i for i in range(len(runs)) if len(runs) - i >= self.fanout and all(self._level(r) <= self._level(runs[i]) for r in runs[i:]) and sum(self._level(r) == self._level(runs[i]) for r in runs[i:]) >= self.fanout), None)
            if start is None:
                return
            some = runs[start:]
            owner = list(self.tables[table].owners())
            gone = None
            if start:
                gone = reduce(DataFrame.union, [self.spark.read.parquet(f"{self._folder(table, r['id'])}/gone").select(*owner) for r in some if r["replaces"]]).distinct()
            merged = self._run(table, self._live(table, some), gone) | {"merged": True}
            while True:
                now = self.state()
                if [r["id"] for r in now.runs.get(table, [])[start : start + len(some)]] != [r["id"] for r in some]:
                    self._delete(self._folder(table, merged["id"]))
                    return  # somebody else has merged them
                after = now.runs[table][start + len(some) :]
                if self._commit(now.number + 1, now.runs | {table: [*runs[:start], merged, *after]}):
                    break

    # Constraints.

    def _check(self, table: str, older: list[dict], run: dict, mine: dict[str, list[dict]], before: State | None = None) -> None:
        """Raises Refused if a row of a new run breaks a rule, a unique key or a reference."""
        spec, rows = self.tables[table], self._rows(table, run)
        if rows is None or not (spec.rules or spec.unique or spec.references):
            return
        runs = [*older, *[r for r in mine.get(table, []) if r["id"] != run["id"]]]

        def refuse(message: str, bad: DataFrame) -> None:
            if some := bad.limit(3).collect():
                self._delete(self._folder(table, run["id"]))
                raise Refused(f"{table}: {message}", some)

        if spec.rules:
            broken = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(True)), n) for n, v in spec.rules().items()]))
            refuse("rules", rows.select(broken.alias("broken"), *spec.owners()).where(F.size("broken") > 0))
        for key in spec.unique:
            full = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in key]))
            refuse(f"not unique: {', '.join(key)}", full.groupBy(*key).count().where("count > 1"))
            if not set(spec.owners()) <= set(key) and runs:
                may = self._may_have(table, runs, key[0], full.select(key[0]))
                there = self._live(table, [*runs, run], lambda r: set() if r["id"] == run["id"] else may.get(r["id"], set()))
                refuse(f"there already: {', '.join(key)}", there.join(full.select(*key), list(key), "left_semi").select(*key))
        for column, parent, name in spec.references:
            named = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()
            ours = [*(before.runs.get(parent, []) if before else self.state().runs.get(parent, [])), *mine.get(parent, [])]
            may = self._may_have(parent, ours, name, named)
            there = self._live(parent, ours, lambda r: may.get(r["id"], set())).select(name)
            refuse(f"{column} names nothing in {parent}", named.join(there, name, "left_anti"))

    def work(self) -> Work:
        """A place for the steps of one run."""
        return Work(self.spark, f"{self.path}/work/{uuid.uuid4().hex}")


#: The filters of a run.
FILTERS = "run string, bucket int, column string, page long, bits binary, least long, greatest long"


def _number(value: Column, kind: str) -> Column:
    """A time or number as an integer that sorts as it does, or as its neighbours do."""
    return F.unix_micros(value.cast("timestamp")) if kind in ("timestamp", "date") else F.floor(value).cast("long")


class Work:
    """Tables that one run writes between its steps; runs at the same time have places of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, []

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def clear(self, *kept: str) -> None:
        """Deletes all tables but those named."""
        for name in self.names:
            if name not in kept:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.names = [n for n in self.names if n in kept]
