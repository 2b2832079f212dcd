"""Series tables: rows in time partitions, each live, sealed or tiered, described by the catalog.

A partition is a list of Parquet folders that writes append to and rewrites
replace; the catalog's next version is what makes either visible. Sealed
partitions are sorted and compressed and number their rows; late rows lie beside
them as a delta, deletions as row numbers. Rows that no partition covers wait in
the default partition.

Every write prepares its folders first and then changes the catalog once. If a
partition that it read was changed meanwhile, the folders are thrown away and
the write is done again, so that of two writers neither loses the other's rows.

All times are kept as time keys: microseconds since 1970 (or the whole number).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions import bucket as B
from tidemark.functions.width import Width
from tidemark.sources.catalog import Catalog

#: Fixed value: partitions of days and time lie on a grid from here.
GRID = dt.datetime(2000, 1, 1)
MOST_PARTITIONS = 100_000
CODECS = {"none": "none", "lz4": "lz4", "zstd": "zstd"}
#: A sealed partition is sealed anew once so many rows, and this share of its rows, have changed.
RESEAL_ROWS = 10_000
RESEAL_SHARE = 0.1
DEFAULT = "default"
#: Stands for the default partition among partition starts.
NOWHERE = -(1 << 62)
#: Times a write is done anew because another came first.
TRIES = 10

#: What a change applies to: rows -> (rows that match, rows that do not).
Match = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Conflict(Exception):
    """Another writer changed a partition that this write had read."""


def _now_key() -> int:
    return B.micros(dt.datetime.now(dt.timezone.utc))


class Series:
    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.spark = catalog, name, catalog.spark

    # --- definition -----------------------------------------------------------------------------------------------

    @classmethod
    def create(
        cls, catalog: Catalog, name: str, schema: StructType | DataFrame, time_column: str, *, interval=None, width: int | None = None,
        premake: int = 4, space_column: str | None = None, space_partitions: int | None = None, now: Any = None,
    ) -> Series:
        """Register a series; rows of a frame given as schema are placed in it."""
        rows = schema if isinstance(schema, DataFrame) else None
        schema = schema.schema if rows is not None else schema
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if time_column not in kinds:
            raise ValueError(f"there is no column {time_column}")
        kind = B.KINDS.get(kinds[time_column])
        if kind is None:
            raise ValueError(f"{time_column} is {kinds[time_column]}: a series runs along a timestamp, a date or a whole number")
        whole = kind in ("long", "int")
        if (interval is None) == (width is None) or whole != (width is not None):
            raise ValueError("give a width for whole numbers, an interval for times")
        if whole and width <= 0:
            raise ValueError("a width is over zero")
        w = None if whole else Width.parse(interval)
        if kind == "date" and not w.calendar:
            raise ValueError("partitions of dates are whole days or months")
        if not 1 <= premake <= 1000:
            raise ValueError("1 to 1000 partitions are made ahead")
        if (space_column is None) != (space_partitions is None) or space_column == time_column or (space_column and space_column not in kinds):
            raise ValueError("a space column is another column, and comes with a number of partitions")
        if space_partitions is not None and not 2 <= space_partitions <= 1024:
            raise ValueError("2 to 1024 space partitions")

        def add(doc: dict) -> None:
            if name in doc["series"] or name in doc["rollups"]:
                raise ValueError(f"{name} exists")
            doc["series"][name] = {
                "schema": schema.json(), "time": time_column, "kind": kind, "months": 0 if whole else w.months, "micros": width if whole else w.micros, "premake": premake,
                "space": space_column, "space_partitions": space_partitions, "retention": None, "seal": None, "tier": None, "default": True,
                "partitions": {DEFAULT: _partition(None, None)}, "dropped_before": None,
            }
            doc["jobs"][f"premake:{name}"] = {"kind": "premake", "target": name, "schedule": 3600, "next_run": 0, "enabled": True}

        catalog.change(add)
        out = cls(catalog, name)
        if rows is not None:
            out.insert(rows)
            out.migrate()
        out.premake(now)
        return out

    @classmethod
    def adopt(cls, catalog: Catalog, name: str, path: str, time_column: str, *, in_place: bool = False, **how: Any) -> Series:
        """A series of the rows of a Parquet table that lies at path, however that is partitioned; path is only read.

        in_place: files whose rows all lie in one partition's range become part of that partition where they are, and
        are never deleted by the series; only the rows of other files are copied. Needs a table whose folder names hold
        no columns.
        """
        table = catalog.spark.read.parquet(path)
        if not in_place:
            return cls.create(catalog, name, table, time_column, **how)
        plain = catalog.spark.read.option("recursiveFileLookup", True).parquet(path)
        if plain.columns != table.columns:
            raise ValueError("columns in folder names are not in the files; adopt without in_place")
        now = how.pop("now", None)
        out = cls.create(catalog, name, table.schema, time_column, now=now, **how)
        spec = out.spec
        key = B.time_key(F.col(time_column), spec["kind"])
        placed = plain.withColumn("_p", out._start_of(spec))
        files = placed.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("_p").alias("a"), F.max("_p").alias("b"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"), F.count(time_column).alias("known")).collect()
        if any(f["n"] != f["known"] for f in files):
            raise ValueError("a row without a time has no place in a series")
        whole = [f for f in files if f["a"] == f["b"]]
        split = [unquote(f["file"]) for f in files if f["a"] != f["b"]]
        if len({f["a"] for f in whole}) > MOST_PARTITIONS:
            raise ValueError(f"over {MOST_PARTITIONS} partitions at once")

        def edit(doc: dict) -> None:
            own = doc["series"][name]
            for f in whole:
                lo, hi = out.range_of(f["a"], own)
                part = own["partitions"].setdefault(out.suffix(lo, own), _partition(lo, hi))
                part["folders"].append(unquote(f["file"]))
                part["rows"] += f["n"]

        catalog.change(edit)
        if split:
            out.insert(out._folders(split, out.spec))
            out.migrate()
        return out

    @property
    def spec(self) -> dict:
        doc = self.catalog.read()
        if self.name not in doc["series"]:
            raise ValueError(f"there is no series {self.name}")
        return doc["series"][self.name]

    def _change(self, edit) -> Any:
        return self.catalog.change(lambda doc: edit(doc["series"][self.name]))

    @property
    def schema(self) -> StructType:
        return _schema(self.spec)

    def add_column(self, name: str, kind: str, default: Any = None) -> None:
        """A further column; rows already stored have its default."""
        added = self.spark.createDataFrame([], f"{name} {kind}").schema.fields[0]

        def edit(s: dict) -> None:
            schema = _schema(s)
            if name in schema.names:
                raise ValueError(f"{name} exists")
            s["schema"] = StructType([*schema.fields, added]).json()
            s["version"] = s.get("version", 0) + 1
            # Folders written before this version know nothing of the column, or of another one of its name.
            s.setdefault("added", {})[name] = [s["version"], default]

        self._change(edit)

    def drop_column(self, name: str) -> None:
        """Hide a column; what is stored of it goes with the next rewrite."""

        def edit(s: dict) -> None:
            schema = _schema(s)
            if name not in schema.names or name in (s["time"], s["space"]):
                raise ValueError(f"{name} cannot be dropped")
            s["schema"] = StructType([f for f in schema.fields if f.name != name]).json()
            s.setdefault("added", {}).pop(name, None)

        self._change(edit)

    # --- ranges ---------------------------------------------------------------------------------------------------

    def range_of(self, key: int, spec: dict | None = None) -> tuple[int, int]:
        """The partition range [lo, hi) that holds a time key."""
        s = spec or self.spec
        if s["kind"] in ("long", "int"):
            lo = key - key % s["micros"]
            return lo, lo + s["micros"]
        if s["months"]:
            t = B.EPOCH + dt.timedelta(microseconds=key)
            k = ((t.year - 2000) * 12 + t.month - 1) // s["months"] * s["months"]
            at = lambda m: B.micros(dt.datetime(2000 + m // 12, m % 12 + 1, 1))
            return at(k), at(k + s["months"])
        lo = key - (key - B.micros(GRID)) % s["micros"]
        return lo, lo + s["micros"]

    def suffix(self, lo: int, spec: dict | None = None) -> str:
        s = spec or self.spec
        if s["kind"] in ("long", "int"):
            return f"p{lo}" if lo >= 0 else f"pm{-lo}"
        t = B.EPOCH + dt.timedelta(microseconds=lo)
        return t.strftime("p%Y%m%d" if s["months"] or s["micros"] % 86_400_000_000 == 0 else "p%Y%m%d_%H%M%S")

    def _start_of(self, spec: dict) -> Column:
        """The start of each row's partition range, as a time key."""
        kind, column = spec["kind"], F.col(spec["time"])
        if spec["months"]:
            clock = B.to_utc(column) if kind == "ltz" else column.cast("timestamp_ntz")
            return B.time_key(B.bucket(clock, Width(months=spec["months"])), "ntz")
        origin = 0 if kind in ("long", "int") else B.micros(GRID)
        key = B.time_key(column, kind)
        return key - F.pmod(key - F.lit(origin), F.lit(spec["micros"]))

    def key(self, value: Any) -> int:
        return value if isinstance(value, int) else B.micros(value)

    # --- making partitions ----------------------------------------------------------------------------------------

    def make_partitions(self, lo: Any, hi: Any) -> int:
        """Cover [lo, hi) with partitions; rows of those ranges leave the default partition. Returns how many are new."""
        s, keys, at = self.spec, [], self.key(lo)
        while at < self.key(hi):
            a, b = self.range_of(at, s)
            keys.append((a, b))
            at = b
            if len(keys) > MOST_PARTITIONS:
                raise ValueError(f"over {MOST_PARTITIONS} partitions at once")
        new = [(a, b) for a, b in keys if self.suffix(a, s) not in s["partitions"]]
        if new:
            self._adopt(new)
        return len(new)

    def premake(self, now: Any = None) -> int:
        s = self.spec
        if s["kind"] in ("long", "int"):
            known = [p["hi"] - 1 for p in s["partitions"].values() if p["hi"] is not None and p["rows"]]
            now = now if now is not None else max(known, default=None)
            if now is None:
                return 0
        at = self.range_of(_now_key() if now is None else self.key(now), s)
        lo = at[0]
        for _ in range(s["premake"]):
            at = self.range_of(at[1], s)
        return self.make_partitions(lo, at[1])

    def _adopt(self, ranges: list[tuple[int, int]]) -> None:
        """Register ranges as partitions, with their rows of the default partition."""

        def make(s: dict) -> tuple[list[str], Any]:
            waiting = s["partitions"].get(DEFAULT, _partition(None, None))
            moved: Written = {}
            if waiting["folders"]:
                rows = self._marked(self._folders(waiting["folders"], s), s, [a for a, _ in ranges])
                moved = self._write(rows, "live", s)

            def edit(doc: dict) -> list[str]:
                own = doc["series"][self.name]
                if moved and own["partitions"].get(DEFAULT) != waiting:
                    raise Conflict
                for a, b in ranges:
                    _append(own["partitions"].setdefault(self.suffix(a, own), _partition(a, b)), moved.get(a))
                if moved:
                    rest = moved.get(NOWHERE)
                    own["partitions"][DEFAULT].update(folders=[rest.folder] if rest else [], rows=rest.rows if rest else 0)
                return waiting["folders"] if moved else []

            return [w.folder for w in moved.values()], edit

        self._discard(self._commit(make))

    def migrate(self, batches: int = 8) -> int:
        """Empty the default partition into partitions of its rows' ranges. Returns how many were made.

        The rows are written once, by range, and stay in the default partition; then the folders move to their
        partitions in up to ``batches`` changes of the catalog, oldest first, so that none holds up other writers.
        """

        def make(s: dict) -> tuple[list[str], Any]:
            waiting = s["partitions"].get(DEFAULT)
            if not waiting or not waiting["folders"]:
                return [], lambda doc: ({}, [])
            rows = self._folders(waiting["folders"], s)
            starts = self._start_of(s)
            if rows.select(starts.alias("p")).distinct().limit(MOST_PARTITIONS + 1).count() > MOST_PARTITIONS:
                raise ValueError(f"over {MOST_PARTITIONS} partitions at once")
            written = self._write(rows.withColumn("_p", starts), "live", s)

            def edit(doc: dict) -> tuple[Written, list[str]]:
                own = doc["series"][self.name]["partitions"]
                if own.get(DEFAULT) != waiting:
                    raise Conflict
                own[DEFAULT]["folders"] = [w.folder for w in written.values()]
                return written, waiting["folders"]

            return [w.folder for w in written.values()], edit

        written, old = self._commit(make)
        self._discard(old)
        starts = sorted(written)
        size = max(1, -(-len(starts) // max(1, batches)))
        for at in range(0, len(starts), size):

            def move(own: dict, some: list[int] = starts[at : at + size]) -> None:
                default = own["partitions"][DEFAULT]
                for a in some:
                    w = written[a]
                    if w.folder in default["folders"]:
                        default["folders"].remove(w.folder)
                        default["rows"] -= w.rows
                        lo, hi = self.range_of(a, own)
                        _append(own["partitions"].setdefault(self.suffix(lo, own), _partition(lo, hi)), w)

            self._change(move)
        return len(starts)

    def drop_default(self) -> bool:
        """Give up the default partition, if it is empty; rows without a partition are then refused."""

        def edit(s: dict) -> bool:
            if s["partitions"].get(DEFAULT, {"rows": 0})["rows"]:
                return False
            s["partitions"].pop(DEFAULT, None)
            s["default"] = False
            return True

        return self._change(edit)

    def drop(self) -> None:
        """Forget the series and delete its rows; refused while rollups read it."""

        def edit(doc: dict) -> list[str]:
            if any(r["source"] == self.name for r in doc["rollups"].values()):
                raise ValueError(f"rollups read {self.name}")
            doc["jobs"] = {k: j for k, j in doc["jobs"].items() if j["target"] != self.name}
            return [f for p in doc["series"].pop(self.name)["partitions"].values() for f in _all_folders(p)]

        self._discard(self.catalog.change(edit))

    # --- writing --------------------------------------------------------------------------------------------------

    def _commit(self, make: Callable[[dict], tuple[list[str], Any]]) -> Any:
        """make: the state of the series -> (folders written, edit of the catalog's document); done again on a conflict."""
        for _ in range(TRIES):
            folders, edit = make(self.spec)
            try:
                return self.catalog.change(edit)
            except Conflict:
                self._discard(folders)
        raise RuntimeError(f"{self.name} is being written to too often")

    def _discard(self, folders: list[str]) -> None:
        """Delete folders of this series; files adopted where they lay are left alone."""
        for folder in folders:
            if _OWN.search(folder):
                self.catalog.files.delete(folder)

    def vacuum(self, grace: float = 3600.0) -> int:
        """Delete folders of the series that are older than grace seconds and that no partition names (left by writers
        that died). Returns how many."""
        root = f"{self.catalog.root}/{self.name}"
        named = {f for p in self.spec["partitions"].values() for f in _all_folders(p)}
        gone = [n for n in self.catalog.files.names(root) if not any(f"{root}/{n}" == f or f.startswith(f"{root}/{n}/") for f in named) and self.catalog.files.age(f"{root}/{n}") >= grace]
        for n in gone:
            self.catalog.files.delete(f"{root}/{n}")
        return len(gone)

    def _new(self, kind: str, spec: dict, root: str | None = None) -> str:
        """A new folder, whose name tells the version of the columns."""
        return f"{root or self.catalog.root}/{self.name}/{kind}-v{spec.get('version', 0)}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, kind: str, spec: dict, codec: str = "zstd", sorted_by: list[str] | None = None, options: dict | None = None) -> Written:
        """Write rows with their partition start in _p: a folder for each start, with its rows and time bounds.

        Rows of one partition are brought together, and large partitions split, before they are written, so that there
        are as many files as the data need; sorted_by: rows are dealt already, and are written in this order.
        """
        out = self._new(kind, spec)
        parts = ["_p"]
        if spec["space"]:
            rows = rows.withColumn("_h", F.pmod(F.xxhash64(spec["space"]), F.lit(spec["space_partitions"])))
            parts.append("_h")
        rows = rows.hint("rebalance", *parts) if sorted_by is None else rows.sortWithinPartitions(*parts, *sorted_by).withColumn("_row", F.monotonically_increasing_id())
        rows.write.partitionBy(*parts).option("compression", codec).options(**(options or {})).parquet(out)
        schema = _schema(spec)
        key = B.time_key(F.col(spec["time"]), spec["kind"])
        back = self.spark.read.schema(StructType([schema[spec["time"]], StructField("_p", LongType())])).parquet(out)
        found = back.groupBy("_p").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()  # a row a partition
        return {r["_p"]: Folder(f"{out}/_p={r['_p']}", r["n"], r["lo"], r["hi"]) for r in found}

    def _marked(self, rows: DataFrame, spec: dict, starts: list[int]) -> DataFrame:
        """rows with _p: the start of their partition's range if it is among starts, else ``NOWHERE``."""
        known = self.spark.createDataFrame([(a,) for a in starts], "_p long")  # as many as there are partitions
        return rows.withColumn("_start", self._start_of(spec)).join(F.broadcast(known), F.col("_start") == F.col("_p"), "left").drop("_start").withColumn("_p", F.coalesce("_p", F.lit(NOWHERE)))

    def _placed(self, rows: DataFrame, spec: dict) -> DataFrame:
        """rows with _p; those without a partition are for the default one, or refused if there is none."""
        out = self._marked(rows, spec, [p["lo"] for name, p in spec["partitions"].items() if name != DEFAULT])
        if not spec["default"]:
            refused = F.raise_error(F.lit("no partition covers these rows and there is no default partition")).cast("long")
            out = out.withColumn("_p", F.when(F.col("_p") == NOWHERE, refused).otherwise(F.col("_p")))
        return out

    def _add(self, doc: dict, written: Written) -> None:
        """Make written folders rows of their partitions."""
        own = doc["series"][self.name]
        known = {p["lo"]: p for name, p in own["partitions"].items() if name != DEFAULT}
        for start, folder in written.items():
            part = known.get(start)
            if part is None:
                if not own["default"]:
                    raise Conflict
                part = own["partitions"].setdefault(DEFAULT, _partition(None, None))
            _append(part, folder)
            part["changed"] += folder.rows
        _invalidate(doc, self.name, _span(written.values()))

    def insert(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Append rows; late ones included. Returns how many.

        batch: the name of a source and the number of its batch. A batch whose number is not above the last one of its
        source is not inserted again; rows and number are one change of the catalog.
        """

        def make(s: dict) -> tuple[list[str], Any]:
            written = self._write(self._placed(self._conform(rows, s), s), "rows", s)

            def edit(doc: dict) -> int:
                if batch:
                    seen = doc.setdefault("batches", {})
                    if seen.get(batch[0], -1) >= batch[1]:
                        return -1
                    seen[batch[0]] = batch[1]
                self._add(doc, written)
                return sum(w.rows for w in written.values())

            made.append([w.folder for w in written.values()])
            return made[-1], edit

        made: list[list[str]] = []
        n = self._commit(make)
        if n < 0:
            self._discard(made[-1])
        return max(n, 0)

    def upsert(self, rows: DataFrame, keys: list[str], on_conflict: str = "nothing") -> int:
        """Insert rows whose keys (the time among them) are not there yet. Where they are, ``nothing`` leaves what is
        there, ``update`` puts the new row in its place. Null keys never conflict. Returns the rows inserted.

        Of new rows with the same keys ``nothing`` takes one, ``update`` refuses them.
        """
        s = self.spec
        if on_conflict not in ("nothing", "update"):
            raise ValueError("on_conflict is nothing or update")
        if s["time"] not in keys:
            raise ValueError("the time is one of the keys")
        kept = self._new("upsert", s)
        whole = F.lit(True)
        for k in keys:
            whole &= F.col(k).isNotNull()
        fresh = self._conform(rows, s)
        fresh.filter(whole).dropDuplicates(keys).unionByName(fresh.filter(~whole)).write.parquet(kept)
        new = self._folders([kept], s)
        try:
            if on_conflict == "update" and new.count() != fresh.count():
                raise ValueError("two new rows have the same keys")
            key = B.time_key(F.col(s["time"]), s["kind"])
            lo, hi = new.agg(F.min(key), F.max(key)).first()
            if lo is None:
                return 0
            if on_conflict == "update":
                names = new.filter(whole).select(*keys)
                return self._rewrite(lambda df: (df.join(names, keys, "left_semi"), df.join(names, keys, "left_anti")), lambda old: new, (lo, hi + 1))[1]

            def make(s: dict) -> tuple[list[str], Any]:
                there = self._within(s, lo, hi + 1)
                written = self._write(self._placed(new.join(self._scan(there).select(*keys), keys, "left_anti"), s), "rows", s)

                def edit(doc: dict) -> int:
                    own = doc["series"][self.name]
                    if self._within(own, lo, hi + 1)["partitions"] != there["partitions"]:
                        raise Conflict
                    self._add(doc, written)
                    return sum(w.rows for w in written.values())

                return [w.folder for w in written.values()], edit

            return self._commit(make)
        finally:
            self.catalog.files.delete(kept)

    def _conform(self, rows: DataFrame, spec: dict) -> DataFrame:
        schema = _schema(spec)
        extra = set(rows.columns) - set(schema.names)
        if extra:
            raise ValueError(f"{self.name} has no columns {sorted(extra)}")
        defaults = {c: d for c, (_, d) in spec.get("added", {}).items()}
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])
        return rows.withColumn(spec["time"], F.when(F.col(spec["time"]).isNull(), F.raise_error(F.lit("a row without a time has no place in a series")).cast(schema[spec["time"]].dataType)).otherwise(F.col(spec["time"])))

    def _rewrite(self, match: Match, fresh: Callable[[DataFrame], DataFrame] | None = None, span: tuple[int, int] | None = None) -> tuple[int, int]:
        """Take out the rows that match and put in those that ``fresh`` makes of them, in one change. Returns how many of each.

        span: time keys [lo, hi) outside of which nothing matches. Live partitions that hold a match are written anew, all
        in one job; sealed ones get a list of deleted rows, all in another.
        """

        def make(s: dict) -> tuple[list[str], Any]:
            near = self._within(s, *(span or (None, None)))["partitions"]
            parts = {n: p for n, p in near.items() if n != DEFAULT and p["rows"]}
            names = {p["lo"]: n for n, p in parts.items()}
            hits: dict[str, Any] = {}
            key = B.time_key(F.col(s["time"]), s["kind"])
            tally = [F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")]
            if parts:
                rows = match(self._scan(s | {"partitions": parts}))[0]
                hits = {names[r["_p"]]: r for r in rows.groupBy(self._start_of(s).alias("_p")).agg(*tally).collect()}  # a row a partition
            if DEFAULT in near and near[DEFAULT]["rows"]:
                r = match(self._folders(near[DEFAULT]["folders"], s))[0].agg(*tally).first()
                if r["n"]:
                    hits[DEFAULT] = r
            found = {n: near[n] for n in hits}
            sealed = {n: p for n, p in found.items() if p["state"] in ("sealed", "tiered")}
            # Rows that lie in folders of their own, whatever the partition's state: these are written anew.
            loose = {n: p["delta"] if n in sealed else p["folders"] for n, p in found.items()}
            made: list[str] = []
            kept: Written = {}
            if any(n != DEFAULT and f for n, f in loose.items()):
                rest = match(self._folders([f for n, fs in loose.items() if n != DEFAULT for f in fs], s))[1]
                kept = self._write(rest.withColumn("_p", self._start_of(s)), "rows", s)
            if DEFAULT in loose:
                kept |= self._write(match(self._folders(loose[DEFAULT], s))[1].withColumn("_p", F.lit(NOWHERE)), "rows", s)
            made += [w.folder for w in kept.values()]
            gone: dict[int, str] = {}
            if sealed:
                folder = self._new("deletes", s)
                made.append(folder)
                rows = match(self._sealed(list(sealed.values()), s))[0].withColumn("_s", self._start_of(s))
                rows.select("_row", "_s", F.col("_s").alias("_p")).write.partitionBy("_p").parquet(folder)
                gone = {int(x[3:]): f"{folder}/{x}" for x in self.catalog.files.names(folder) if x.startswith("_p=")}
            added: Written = {}
            if fresh is not None:
                added = self._write(self._placed(fresh(match(self._scan(s | {"partitions": found}))[0] if found else self._empty(s)), s), "rows", s)
                made += [w.folder for w in added.values()]

            def edit(doc: dict) -> tuple[int, int, list[str]]:
                own, old = doc["series"][self.name], []
                if any(own["partitions"].get(n) != p for n, p in (near if span else found).items()):
                    raise Conflict
                for n, p in found.items():
                    part, w = own["partitions"][n], kept.get(NOWHERE if n == DEFAULT else p["lo"])
                    late = "delta" if n in sealed else "folders"
                    old += part[late]
                    part[late] = [w.folder] if w else []
                    part["rows"] -= hits[n]["n"]
                    if n in sealed:
                        part["changed"] += hits[n]["n"]
                        part["deletes"] += [gone[p["lo"]]] if p["lo"] in gone else []
                n = sum(h["n"] for h in hits.values())
                if n:
                    _invalidate(doc, self.name, (min(h["lo"] for h in hits.values()), max(h["hi"] for h in hits.values())))
                self._add(doc, added)
                return n, sum(w.rows for w in added.values()), old

            return made, edit

        n, more, old = self._commit(make)
        self._discard(old)
        return n, more

    def delete(self, where: str) -> int:
        """Delete the rows for which the SQL condition holds. Returns how many."""
        return self._rewrite(_condition(where))[0]

    def update(self, where: str, values: dict[str, str]) -> int:
        """Set columns to SQL expressions in the rows for which the condition holds. Returns how many."""

        def changed(rows: DataFrame) -> DataFrame:
            return self._conform(rows.select(*[F.expr(values[c]).cast(rows.schema[c].dataType).alias(c) if c in values else F.col(c) for c in rows.columns]), self.spec)

        return self._rewrite(_condition(where), changed)[0]

    def truncate(self) -> None:
        """Delete all rows; partitions stay."""

        def edit(doc: dict) -> list[str]:
            own = doc["series"][self.name]["partitions"]
            old = [f for p in own.values() for f in _all_folders(p)]
            for name, p in own.items():
                own[name] = _partition(p["lo"], p["hi"])
            _invalidate(doc, self.name, (-(1 << 62), 1 << 62))
            return old

        self._discard(self.catalog.change(edit))

    # --- reading --------------------------------------------------------------------------------------------------

    def _folders(self, folders: list[str], spec: dict, more: str | None = None) -> DataFrame:
        """The rows of folders (or files), each with the columns of its time; later columns have their defaults."""
        schema, added = _schema(spec), spec.get("added", {})
        groups: dict[tuple[str, ...], list[str]] = {}
        for f in folders:
            groups.setdefault(tuple(c for c, (since, _) in added.items() if _version(f) < since), []).append(f)
        out = None
        for absent, some in groups.items():
            fields = [f for f in schema.fields if f.name not in absent]
            # Folders are taken as they are: their names are no columns.
            rows = self.spark.read.schema(StructType([*fields, *([StructField(more, LongType())] if more else [])])).option("recursiveFileLookup", True).parquet(*some)
            columns = [F.lit(added[f.name][1]).cast(f.dataType).alias(f.name) if f.name in absent else F.col(f.name) for f in schema.fields]
            rows = rows.select(*columns, *([more] if more else [])) if absent else rows
            out = rows if out is None else out.unionByName(rows)
        return self._empty(spec) if out is None else out

    def _empty(self, spec: dict) -> DataFrame:
        return self.spark.createDataFrame([], _schema(spec))

    def _sealed(self, parts: list[dict], spec: dict, files: list[str] | None = None) -> DataFrame:
        """The sorted rows of sealed partitions (or of some of their files) with their numbers, without deleted ones."""
        rows = self._folders(files if files is not None else [f for p in parts for f in p["folders"]], spec, "_row")
        deletes = [f for p in parts for f in p["deletes"]]
        if deletes:
            gone = self.spark.read.schema("_row long, _s long").option("recursiveFileLookup", True).parquet(*deletes).distinct()
            rows = rows.withColumn("_s", self._start_of(spec)).join(gone, ["_s", "_row"], "left_anti").drop("_s")
        return rows

    def _partition_rows(self, p: dict, spec: dict) -> DataFrame | None:
        return self._scan(spec | {"partitions": {"p": p}}) if p["folders"] or p["delta"] else None

    def _within(self, spec: dict, lo: int | None, hi: int | None) -> dict:
        """The series as if it had only the partitions that may hold time keys of [lo, hi)."""
        near = lambda p: p["lo"] is None or ((hi is None or p["lo"] < hi) and (lo is None or p["hi"] > lo))
        return spec | {"partitions": {n: p for n, p in spec["partitions"].items() if near(p)}}

    def _scan(self, spec: dict) -> DataFrame:
        """All rows: one scan of what needs no join, and one of the sealed partitions that rows were deleted from."""
        parts = spec["partitions"].values()
        marked = [p for p in parts if p["deletes"]]
        plain = [f for p in parts for f in [*([] if p["deletes"] else p["folders"]), *p["delta"]]]
        out = self._folders(plain, spec)
        return out.unionByName(self._sealed(marked, spec).drop("_row")) if marked else out

    def between(self, ranges: list[tuple[int | None, int | None]]) -> DataFrame:
        """The rows whose time keys lie in one of the ranges [lo, hi), from the partitions that may hold any."""
        spec = self.spec
        parts: dict[str, dict] = {}
        for lo, hi in ranges:
            parts |= self._within(spec, lo, hi)["partitions"]
        return self._scan(spec | {"partitions": parts}).filter(in_ranges(F.col(spec["time"]), spec["kind"], ranges))

    def scan(self, start: Any = None, finish: Any = None) -> DataFrame:
        """The rows of [start, finish), from the partitions that may hold any."""
        if start is None and finish is None:
            return self._scan(self.spec)
        return self.between([tuple(None if x is None else self.key(x) for x in (start, finish))])

    def ordered(self, *by: str, desc: bool = False, start: Any = None, finish: Any = None) -> DataFrame:
        """As ``scan``, in the order of the columns (the order of sealing by default), late rows among the others."""
        rows = self.scan(start, finish)
        return rows.orderBy(*[F.col(c).desc_nulls_first() if desc else F.col(c).asc_nulls_last() for c in by or self._order(self.spec, None)])

    def seek(self, column: str, values: list, start: Any = None, finish: Any = None) -> DataFrame:
        """The rows of [start, finish) whose column is one of values. Of partitions sealed in an order of that column
        only the files are read whose least and greatest value leave room for one of them."""
        spec = self._within(self.spec, *(None if x is None else self.key(x) for x in (start, finish)))
        known, rest = {}, {}
        for n, p in spec["partitions"].items():
            (known if p.get("stats") and column in p["order_by"] else rest)[n] = p
        rows = self._scan(spec | {"partitions": rest | {n: p | {"folders": [], "deletes": []} for n, p in known.items()}})
        groups: dict[int, list[dict]] = {}
        for p in known.values():
            groups.setdefault(p["order_by"].index(column), []).append(p)
        kind = next(f.dataType for f in _schema(spec).fields if f.name == column)
        for i, some in groups.items():
            least, most = F.col(f"least{i}"), F.col(f"most{i}")
            wanted = F.lit(False)
            for v in values:
                wanted |= (F.lit(v).cast(kind) >= least) & (F.lit(v).cast(kind) <= most)
            stats = self.spark.read.schema(StructType([StructField("file", StringType()), StructField(f"least{i}", kind), StructField(f"most{i}", kind)])).parquet(*[p["stats"] for p in some])
            files = [unquote(r["file"]) for r in stats.filter(wanted).select("file").collect()]  # the files to be read
            if files:
                rows = rows.unionByName(self._sealed(some, spec, files).drop("_row"))
        edges = [tuple(None if x is None else self.key(x) for x in (start, finish))]
        return rows.filter(F.col(column).isin(values) & in_ranges(F.col(spec["time"]), spec["kind"], edges))

    def analyze(self) -> DataFrame:
        """Of every column: its rows, nulls, an estimate of its distinct values, and its least and greatest as text."""
        rows, names = self.scan(), _schema(self.spec).names
        each = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(F.to_json(F.struct(c))).alias("distinct"), F.min(F.col(c)).cast("string").alias("least"), F.max(F.col(c)).cast("string").alias("most")) for c in names]
        return rows.agg(F.array(*each).alias("all")).select(F.inline("all"))

    # --- sealing and tiering --------------------------------------------------------------------------------------

    def _part(self, name: str, states: tuple[str, ...]) -> tuple[dict, dict]:
        s = self.spec
        if name not in s["partitions"] or name == DEFAULT:
            raise ValueError(f"{self.name} has no partition {name}")
        p = s["partitions"][name]
        if p["state"] not in states:
            raise ValueError(f"{name} is {p['state']}")
        return s, p

    def _replace(self, name: str, before: dict, after: dict) -> None:
        def edit(s: dict) -> None:
            if s["partitions"].get(name) != before:
                raise RuntimeError(f"{name} was written to meanwhile; do it again")
            s["partitions"][name] = after

        try:
            self._change(edit)
        except RuntimeError:
            self._discard(sorted(set(_all_folders(after)) - set(_all_folders(before))))
            raise
        self._discard(sorted(set(_all_folders(before)) - set(_all_folders(after))))

    def _order(self, s: dict, order_by: list[str] | None) -> list[str]:
        return order_by or (s["seal"] or {}).get("order_by") or [*([s["space"]] if s["space"] else []), s["time"]]

    def seal(self, name: str, *, order_by: list[str] | None = None, codec: str | None = None) -> int:
        """Rewrite a live partition sorted and compressed, its rows numbered. Returns how many rows."""
        s, p = self._part(name, ("live",))
        return self._seal(name, s, p, order_by, codec)

    def _seal(self, name: str, s: dict, p: dict, order_by, codec) -> int:
        codec = codec or (s["seal"] or {}).get("codec", "lz4")
        if codec not in CODECS:
            raise ValueError(f"a codec is one of {', '.join(CODECS)}")
        order = self._order(s, order_by)
        rows = self._partition_rows(p, s)
        before = sum(self.catalog.files.size(f) for f in _all_folders(p))
        folders, n, stats = [], 0, None
        if rows is not None:
            group = (s["seal"] or {}).get("group_rows")
            written = self._write(rows.repartitionByRange(*order).withColumn("_p", self._start_of(s)), "sealed", s, CODECS[codec], order, {"parquet.block.row.count.limit": group} if group else None)
            folders, n = [w.folder for w in written.values()], sum(w.rows for w in written.values())
            stats = self._measured(folders, order, s)
        self._replace(name, p, _partition(p["lo"], p["hi"]) | {"state": "sealed", "folders": folders, "rows": n, "bytes_before": p.get("bytes_before") or before, "codec": codec, "order_by": order, "stats": stats})
        return n

    def _measured(self, folders: list[str], order: list[str], spec: dict) -> str | None:
        """Write the least and greatest values that each sealed file has of the columns it is ordered by."""
        if not folders:
            return None
        out = self._new("stats", spec)
        file = F.col("_metadata.file_path").alias("file")
        self._folders(folders, spec).groupBy(file).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(order) for n, f in (("least", F.min), ("most", F.max))]).write.parquet(out)
        return out

    def reseal(self, name: str) -> int:
        """Fold late rows and deletions into a sealed partition."""
        s, p = self._part(name, ("sealed", "tiered"))
        n = self._seal(name, s, p, p.get("order_by"), p.get("codec"))
        if p["state"] == "tiered":
            self.tier(name)
        return n

    def unseal(self, name: str) -> int:
        s, p = self._part(name, ("sealed",))
        rows = self._partition_rows(p, s)
        written = self._write(rows.withColumn("_p", F.lit(p["lo"])), "live", s) if rows is not None else {}
        n = sum(w.rows for w in written.values())
        self._replace(name, p, _partition(p["lo"], p["hi"]) | {"folders": [w.folder for w in written.values()], "rows": n})
        return n

    def tier(self, name: str, root: str | None = None) -> int:
        """Move a sealed partition's sorted files to another root; late rows and deletions stay here."""
        s, p = self._part(name, ("sealed",))
        root = root or (s["tier"] or {}).get("root")
        if not root:
            raise ValueError("there is no root to tier to")
        return self._move(name, s, p, root, "tiered")

    def recall(self, name: str) -> int:
        s, p = self._part(name, ("tiered",))
        return self._move(name, s, p, f"{self.catalog.root}/{self.name}", "sealed")

    def _move(self, name: str, s: dict, p: dict, root: str, state: str) -> int:
        """Write the sorted rows, numbered as they are, to another root: a job of Spark's, not of the driver's."""
        folders = []
        if p["folders"]:
            to = f"{root.rstrip('/')}/{self.name}-{name}-v{s.get('version', 0)}-{uuid.uuid4().hex}"
            group = (s["seal"] or {}).get("group_rows")
            out = self._folders(p["folders"], s, "_row").repartitionByRange("_row").sortWithinPartitions("_row").write.option("compression", CODECS[p.get("codec", "lz4")])
            (out.option("parquet.block.row.count.limit", group) if group else out).parquet(to)
            folders = [to]
        self._replace(name, p, p | {"state": state, "folders": folders, "stats": self._measured(folders, p["order_by"], s)})
        return p["rows"]

    def tier_gc(self, grace: float = 3600.0) -> int:
        """Delete what lies under the tier's root for this series, is older than grace seconds, and no partition names."""
        s = self.spec
        root = (s["tier"] or {}).get("root")
        if not root:
            return 0
        named = {f.rsplit("/", 1)[-1] for p in s["partitions"].values() for f in _all_folders(p)}
        gone = [n for n in self.catalog.files.names(root) if n.startswith(f"{self.name}-p") and n not in named and self.catalog.files.age(f"{root}/{n}") >= grace]
        for n in gone:
            self.catalog.files.delete(f"{root}/{n}")
        return len(gone)

    def set_sealing(self, after, *, codec: str = "lz4", order_by: list[str] | None = None, group_rows: int | None = None) -> None:
        """Seal partitions that ended so long ago (an interval, or a whole number behind the greatest).

        group_rows: rows of a row group at most, the unit that is skipped; by default row groups are cut by bytes.
        """
        if codec not in CODECS:
            raise ValueError(f"a codec is one of {', '.join(CODECS)}")
        if group_rows is not None and not 1 <= group_rows <= 65_536:
            raise ValueError("a row group has 1 to 65536 rows")
        self._policy("seal", {"after": self._length(after), "codec": codec, "order_by": order_by, "group_rows": group_rows})

    def set_tiering(self, after, root: str) -> None:
        self._policy("tier", {"after": self._length(after), "root": root})

    def set_retention(self, after) -> None:
        self._policy("retention", None if after is None else {"after": self._length(after)})

    def _length(self, after) -> list[int]:
        if self.spec["kind"] in ("long", "int"):
            if not isinstance(after, int) or after <= 0:
                raise ValueError("whole numbers have a whole width over zero")
            return [0, after]
        w = Width.parse(after)
        return [w.months, w.micros]

    def _policy(self, kind: str, value: dict | None) -> None:
        def edit(doc: dict) -> None:
            doc["series"][self.name][kind] = value
            job = f"{kind}:{self.name}"
            if value is None:
                doc["jobs"].pop(job, None)
            else:
                doc["jobs"].setdefault(job, {"kind": kind, "target": self.name, "schedule": 3600, "next_run": 0, "enabled": True})

        self.catalog.change(edit)

    def cutoff(self, length: list[int], now: Any = None) -> int | None:
        s = self.spec
        if s["kind"] in ("long", "int"):
            top = max((p["hi"] for p in s["partitions"].values() if p["hi"] is not None and p["rows"]), default=None) if now is None else now
            return None if top is None else top - length[1]
        at = _now_key() if now is None else self.key(now)
        return before(at, length)

    def due(self, policy: str, now: Any = None) -> list[str]:
        """Partitions that a policy is to act on, oldest first."""
        s = self.spec
        if not s[policy]:
            return []
        cut = self.cutoff(s[policy]["after"], now)
        state = {"seal": "live", "tier": "sealed"}[policy]
        return [n for n, p in sorted(s["partitions"].items(), key=lambda x: x[1]["lo"] or 0) if n != DEFAULT and cut is not None and p["hi"] <= cut and p["state"] == state and p["rows"]]

    def due_reseal(self) -> list[str]:
        return [n for n, p in self.spec["partitions"].items() if p["state"] in ("sealed", "tiered") and p["changed"] > max(RESEAL_ROWS, RESEAL_SHARE * p["rows"])]

    def drop_before(self, cut: Any) -> int:
        """Drop whole partitions that end at or before cut. Returns how many."""
        key = self.key(cut)

        def edit(s: dict) -> list[dict]:
            names = [n for n, p in s["partitions"].items() if n != DEFAULT and p["hi"] <= key]
            if names:
                s["dropped_before"] = max([s["dropped_before"] or -(1 << 62), *[s["partitions"][n]["hi"] for n in names]])
            return [s["partitions"].pop(n) for n in names]

        gone = self._change(edit)
        self._discard([f for p in gone for f in _all_folders(p)])
        return len(gone)

    def apply_retention(self, now: Any = None) -> int:
        s = self.spec
        cut = self.cutoff(s["retention"]["after"], now) if s["retention"] else None
        return 0 if cut is None else self.drop_before(cut)

    # --- what is there --------------------------------------------------------------------------------------------

    def column_sizes(self, name: str) -> DataFrame:
        """Of a partition's files, from their footers: values, nulls and bytes by column and encodings.

        Tasks read the footers, on the file systems that Arrow knows; the driver only lists files.
        """
        p = self.spec["partitions"][name]
        paths = self.spark.read.option("recursiveFileLookup", True).parquet(*p["folders"]).inputFiles() if p["folders"] else []
        files = self.spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, min(len(paths), 200)))
        each = files.mapInPandas(_footers, "column string, encodings string, groups long, rows long, nulls long, bytes long")
        return each.groupBy("column", "encodings").agg(*[F.sum(c).alias(c) for c in ("groups", "rows", "nulls", "bytes")])


def _footers(batches):
    import pandas as pd
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch["path"]:
            system, inside = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
            with system.open_input_file(inside) as f:
                meta = pq.read_metadata(f)
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    col = meta.row_group(g).column(c)
                    nulls = col.statistics.null_count if col.statistics and col.statistics.has_null_count else 0
                    rows.append((col.path_in_schema, ",".join(sorted(col.encodings)), 1, col.num_values, nulls, col.total_compressed_size))
        yield pd.DataFrame(rows, columns=["column", "encodings", "groups", "rows", "nulls", "bytes"])


class Folder(NamedTuple):
    """A folder just written: its rows, and the least and greatest of their time keys."""

    folder: str
    rows: int
    lo: int
    hi: int


#: Folders by partition start.
Written = dict[int, Folder]

#: Names of folders that a series has made (others were adopted), with the version of its columns.
_OWN = re.compile(r"-v(\d+)-[0-9a-f]{32}")


def _version(folder: str) -> int:
    found = _OWN.search(folder)
    return int(found[1]) if found else 0


def _schema(spec: dict) -> StructType:
    return StructType.fromJson(json.loads(spec["schema"]))


def _condition(where: str) -> Match:
    return lambda rows: (rows.filter(where), rows.filter(f"not coalesce(({where}), false)"))


def _append(part: dict, written: Folder | None) -> None:
    if written:
        part["delta" if part["state"] in ("sealed", "tiered") else "folders"].append(written.folder)
        part["rows"] += written.rows


def _span(folders) -> tuple[int, int] | None:
    folders = list(folders)
    return (min(w.lo for w in folders), max(w.hi for w in folders)) if folders else None


def edge(kind: str, key: int) -> Column:
    """A time key as a literal of the time column's own type, so that comparisons reach the files."""
    if kind in ("long", "int"):
        return F.lit(key)
    at = B.ntz(B.EPOCH + dt.timedelta(microseconds=key))
    return B.from_utc(at) if kind == "ltz" else at.cast("date") if kind == "date" else at


def in_ranges(column: Column, kind: str, ranges: list[tuple[int | None, int | None]]) -> Column:
    """Whether a time column lies in one of the ranges of time keys [lo, hi); None or a key beyond all times: no edge."""
    out = F.lit(False)
    for lo, hi in ranges:
        inside = F.lit(True)
        if lo is not None and abs(lo) < 1 << 62:
            inside &= column >= edge(kind, lo)
        if hi is not None and abs(hi) < 1 << 62:
            inside &= column < edge(kind, hi)
        out |= inside
    return out


def before(at: int, length: list[int]) -> int:
    """The time key that lies months and microseconds before another; a day that the month has not is its last."""
    if not length[0]:
        return at - length[1]
    t = B.EPOCH + dt.timedelta(microseconds=at)
    m = t.year * 12 + t.month - 1 - length[0]
    day = min(t.day, (dt.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day)
    return B.micros(t.replace(year=m // 12, month=m % 12 + 1, day=day))


def _partition(lo: int | None, hi: int | None) -> dict:
    return {"lo": lo, "hi": hi, "state": "live", "folders": [], "delta": [], "deletes": [], "rows": 0, "changed": 0}


def _all_folders(p: dict) -> list[str]:
    return [*p["folders"], *p["delta"], *p["deletes"], *([p["stats"]] if p.get("stats") else [])]


def _invalidate(doc: dict, source: str, bounds: tuple[int, int] | None) -> None:
    """Note a changed stretch of time with every rollup that reads source, directly or not."""
    if bounds is None:
        return
    for name, r in doc["rollups"].items():
        if r["source"] == source:
            r["invalid"].append([r["next_id"], *bounds])
            r["next_id"] += 1
            _invalidate(doc, name, bounds)


def partition_info(catalog: Catalog) -> DataFrame:
    rows = []
    for name, s in catalog.read()["series"].items():
        for part, p in s["partitions"].items():
            state = "default" if part == DEFAULT else "spread" if s["space"] and p["state"] == "live" else p["state"]
            rows.append((name, part, state, p["lo"], p["hi"], p["rows"], sum(catalog.files.size(f) for f in _all_folders(p)), s["space_partitions"] or 0, p.get("bytes_before")))
    return catalog.spark.createDataFrame(rows, "series string, name string, state string, range_start long, range_end long, rows long, bytes long, children int, bytes_before long")


def series_info(catalog: Catalog) -> DataFrame:
    parts = partition_info(catalog)
    own = F.col("state") != DEFAULT
    sums = parts.groupBy("series").agg(
        F.count_if(own).cast("int").alias("partitions"), F.min(F.when(own, F.col("range_start"))).alias("oldest_range"), F.max(F.when(own, F.col("range_end"))).alias("newest_range"),
        F.coalesce(F.sum(F.when(~own, F.col("rows"))), F.lit(0)).alias("rows_in_default"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum(F.when((F.col("state") == "sealed") & F.col("bytes_before").isNotNull(), F.col("bytes"))), F.lit(0)).alias("sealed_bytes"),
        F.coalesce(F.sum(F.when(F.col("state") == "sealed", F.col("bytes_before"))), F.lit(0)).alias("sealed_bytes_before"),
    )
    said = [(n, s["time"], s["kind"], s["months"], s["micros"], s["space"], s["space_partitions"]) for n, s in catalog.read()["series"].items()]
    return catalog.spark.createDataFrame(said, "series string, time_column string, kind string, months long, micros long, space_column string, space_partitions int").join(sums, "series", "left")
