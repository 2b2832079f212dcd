"""Rollups: aggregates by time bucket, kept in storage and never stale.

What is read is the stored buckets before the watermark, without those that
changed since, together with a live aggregate of the rest. A refresh aggregates
changed stretches anew and moves the watermark to the bucket still filling.

Storage is a list of folders, each with the time ranges for which it speaks. A
refresh writes the ranges it made anew to one more folder and takes them from
the others, so that it writes as much as changed; when there are ``FOLDERS``,
they are written together. The source is read for those ranges only.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bucket as B
from tidemark.functions.width import Width
from tidemark.sources.catalog import Catalog
from tidemark.sources.series import Series, _now_key, before, in_ranges

LEAST, MOST = -(1 << 62), 1 << 62
#: Folders of a rollup before a refresh writes them together.
FOLDERS = 16

Range = tuple[int, int]
#: Aggregates of aggregates that would be wrong.
UNMERGEABLE = re.compile(r"\b(avg|mean|percentile\w*|approx_percentile|mode|median|stddev\w*|std|var\w*|variance)\s*\(|\bcount\s*\(\s*distinct\b", re.IGNORECASE)


class Rollup:
    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.spark = catalog, name, catalog.spark

    @classmethod
    def create(cls, catalog: Catalog, name: str, source: str, *, bucket=None, bucket_width: int | None = None, select: str, group_by: list[str] | None = None) -> Rollup:
        """select: SQL aggregates with aliases, and the names in group_by; the bucket is the column ``bucket``."""
        doc = catalog.read()
        if name in doc["rollups"] or name in doc["series"]:
            raise ValueError(f"{name} exists")
        below = doc["rollups"].get(source)
        if below is None and source not in doc["series"]:
            raise ValueError(f"there is no series or rollup {source}")
        kind = (below or doc["series"][source])["kind"]
        whole = kind in ("long", "int")
        if whole != (bucket_width is not None) or whole == (bucket is not None):
            raise ValueError("give a bucket_width for whole numbers, a bucket for times")
        w = Width(0, bucket_width) if whole else Width.parse(bucket)
        if below is not None and UNMERGEABLE.search(select):
            raise ValueError("an aggregate in the select list cannot be made from parts; keep sums and counts instead")
        if below is not None and not _nests(Width(below["months"], below["micros"]), w):
            raise ValueError("buckets of a rollup's rollup are made of whole buckets below")
        for g in group_by or []:
            if not re.fullmatch(r"\w+", g):
                raise ValueError("group_by has plain column names")
        spec = {"source": source, "kind": kind, "months": w.months, "micros": w.micros, "select": select, "group_by": group_by or [], "watermark": LEAST, "stored": [], "invalid": [], "next_id": 0, "retention": None, "dropped_before": None}
        out = cls(catalog, name)
        columns = out._aggregate(spec, [(LEAST, MOST)]).columns
        missing = [g for g in group_by or [] if g not in columns]
        if missing:
            raise ValueError(f"select has no {missing}")

        def add(doc: dict) -> None:
            doc["rollups"][name] = spec
            doc["jobs"][f"refresh:{name}"] = {"kind": "refresh", "target": name, "schedule": 60, "next_run": 0, "enabled": True}

        catalog.change(add)
        return out

    @property
    def spec(self) -> dict:
        return self.catalog.read()["rollups"][self.name]

    def _source(self, spec: dict, ranges: list[Range]) -> tuple[DataFrame, str]:
        """The source's rows of the ranges, from the files that may hold any, and its time column."""
        doc = self.catalog.read()
        if spec["source"] in doc["rollups"]:
            return Rollup(self.catalog, spec["source"]).read(ranges), "bucket"
        return Series(self.catalog, spec["source"]).between(ranges), doc["series"][spec["source"]]["time"]

    def _bucket(self, spec: dict, time: str) -> Column:
        width = spec["micros"] if spec["kind"] in ("long", "int") else Width(spec["months"], spec["micros"])
        return B.bucket(F.col(time), width, kind=spec["kind"])

    def _bucket_key(self, spec: dict, key: int) -> tuple[int, int]:
        """The bucket [start, end) of a time key."""
        if abs(key) >= MOST:
            return key, key
        if spec["kind"] in ("long", "int"):
            lo = key - key % spec["micros"]
            return lo, lo + spec["micros"]
        if spec["months"]:
            t = B.EPOCH + dt.timedelta(microseconds=key)
            k = ((t.year - 2000) * 12 + t.month - 1) // spec["months"] * spec["months"]
            at = lambda m: B.micros(dt.datetime(2000 + m // 12, m % 12 + 1, 1))
            return at(k), at(k + spec["months"])
        lo = key - (key - B.micros(B.ORIGIN)) % spec["micros"]
        return lo, lo + spec["micros"]

    def _aggregate(self, spec: dict, ranges: list[Range]) -> DataFrame:
        """The live aggregate of the time ranges [lo, hi)."""
        rows, time = self._source(spec, ranges)
        base = rows.withColumn("bucket", self._bucket(spec, time))
        items = [x for x in _split(spec["select"]) if x.strip() not in spec["group_by"]]
        return base.groupBy("bucket", *spec["group_by"]).agg(*[F.expr(x) for x in items])

    def _pending(self, spec: dict) -> list[Range]:
        """Changed ranges before the watermark, as merged whole buckets; none where raw rows may be gone."""
        floor = self._floor(spec)
        return _merge([(max(self._bucket_key(spec, lo)[0], floor), min(self._bucket_key(spec, hi)[1], spec["watermark"])) for _, lo, hi in spec["invalid"]])

    def _floor(self, spec: dict) -> int:
        """Buckets before this may have lost rows to the source's retention, and are not made anew."""
        doc = self.catalog.read()
        below = doc["series"].get(spec["source"]) or doc["rollups"][spec["source"]]
        gone = below["dropped_before"]
        if gone is None:
            return LEAST
        lo, hi = self._bucket_key(spec, gone)
        return gone if lo == gone else hi

    def _stored(self, spec: dict, without: list[Range], ranges: list[Range], columns: list[str]) -> DataFrame | None:
        """What storage says of ranges, but for some."""
        out = None
        for part in spec["stored"]:
            own = _minus(_common(part["ranges"], ranges), without)
            if own:
                rows = self.spark.read.parquet(part["folder"]).filter(in_ranges(F.col("bucket"), spec["kind"], own)).select(*columns)
                out = rows if out is None else out.unionByName(rows)
        return out

    def read(self, ranges: list[Range] | None = None) -> DataFrame:
        """The rollup as of now: stored buckets that still hold, and the rest aggregated live.

        ranges: of time keys [lo, hi), whole buckets; all by default.
        """
        spec, ranges = self.spec, _merge(ranges or [(LEAST, MOST)])
        pending = self._pending(spec)
        live = self._aggregate(spec, _common([*pending, (spec["watermark"], MOST)], ranges))
        stored = self._stored(spec, pending, ranges, live.columns)
        return live if stored is None else stored.unionByName(live)

    def refresh(self, now: Any = None) -> int:
        """Bring storage up to date. Returns the number of ranges made anew."""
        spec = self.spec
        if spec["kind"] in ("long", "int"):
            rows, time = self._source(spec, [(spec["watermark"], MOST)])
            top = rows.agg(F.max(time)).first()[0] if now is None else now
            if top is None:
                return 0
            mark = self._bucket_key(spec, top)[0]
        else:
            mark = self._bucket_key(spec, _now_key() if now is None else B.micros(now))[0]
        mark = max(mark, spec["watermark"])
        ranges = _merge([*self._pending(spec), (max(spec["watermark"], self._floor(spec)), mark)])
        if not ranges and mark == spec["watermark"]:
            return 0
        fresh, own = self._aggregate(spec, ranges), ranges
        together = len(spec["stored"]) >= FOLDERS
        if together and (old := self._stored(spec, ranges, [(LEAST, MOST)], fresh.columns)) is not None:
            fresh, own = fresh.unionByName(old), _merge([*ranges, *[tuple(r) for part in spec["stored"] for r in part["ranges"]]])
        folder = f"{self.catalog.root}/{self.name}/rollup-{uuid.uuid4().hex}"
        fresh.repartitionByRange("bucket").sortWithinPartitions("bucket").write.parquet(folder)
        seen = {i for i, _, _ in spec["invalid"]}
        kept = [] if together else [{"folder": p["folder"], "ranges": left} for p in spec["stored"] if (left := _minus(p["ranges"], ranges))]

        def edit(doc: dict) -> list[str]:
            mine = doc["rollups"][self.name]
            if mine["stored"] != spec["stored"] or mine["watermark"] != spec["watermark"]:
                raise RuntimeError(f"{self.name} was refreshed meanwhile")
            mine["stored"], mine["watermark"] = [*kept, {"folder": folder, "ranges": own}], mark
            mine["invalid"] = [x for x in mine["invalid"] if x[0] not in seen]  # what came since stays
            return [p["folder"] for p in spec["stored"] if p["folder"] not in {k["folder"] for k in kept}]

        try:
            old = self.catalog.change(edit)
        except RuntimeError:
            self.catalog.files.delete(folder)
            raise
        for gone in old:
            self.catalog.files.delete(gone)
        if spec["retention"]:
            self.apply_retention(now)
        return len(ranges)

    def set_retention(self, after) -> None:
        length = [0, after] if self.spec["kind"] in ("long", "int") else [(w := Width.parse(after)).months, w.micros]
        self.catalog.change(lambda doc: doc["rollups"][self.name].__setitem__("retention", length))

    def apply_retention(self, now: Any = None) -> int:
        """Drop stored buckets that ended before the retention's cutoff. Returns how many folders went with them."""
        spec = self.spec
        at = spec["watermark"] if spec["kind"] in ("long", "int") else (_now_key() if now is None else B.micros(now))
        cut = self._bucket_key(spec, before(at, spec["retention"]))[0]

        def edit(doc: dict) -> list[str]:
            own = doc["rollups"][self.name]
            own["dropped_before"] = max(cut, own["dropped_before"] or LEAST)
            left = [{"folder": p["folder"], "ranges": r} for p in own["stored"] if (r := _common(p["ranges"], [(cut, MOST)]))]
            gone = {p["folder"] for p in own["stored"]} - {p["folder"] for p in left}
            own["stored"] = left
            return sorted(gone)

        gone = self.catalog.change(edit)
        for folder in gone:
            self.catalog.files.delete(folder)
        return len(gone)

    def drop(self) -> None:
        def edit(doc: dict) -> list[str]:
            if any(r["source"] == self.name for r in doc["rollups"].values()):
                raise ValueError(f"rollups read {self.name}")
            doc["jobs"].pop(f"refresh:{self.name}", None)
            return [p["folder"] for p in doc["rollups"].pop(self.name)["stored"]]

        for folder in self.catalog.change(edit):
            self.catalog.files.delete(folder)


def _nests(small: Width, large: Width) -> bool:
    if bool(small.months) != bool(large.months):
        return bool(large.months) and small.micros and 86_400_000_000 % small.micros == 0
    return (large.months % small.months if small.months else large.micros % small.micros) == 0


def _common(a: list[Range], b: list[Range]) -> list[Range]:
    """What ranges a and b have in common."""
    return _merge([(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b])


def _minus(a: list[Range], b: list[Range]) -> list[Range]:
    """What of ranges a is not in ranges b."""
    for lo, hi in b:
        a = [r for x in a for r in ((x[0], min(x[1], lo)), (max(x[0], hi), x[1])) if r[0] < r[1]]
    return [tuple(r) for r in a]


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] < r[1]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _split(select: str) -> list[str]:
    """The items of a select list, at commas outside parentheses and quotes."""
    out, depth, quote, item = [], 0, "", ""
    for c in select:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(item)
            item = ""
        else:
            item += c
    return [x for x in [*out, item] if x.strip()]
