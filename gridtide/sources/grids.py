"""Binary grid files: big-endian floats of 13 square tiles, the last six stored as two slabs."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridtide.functions.shipping import ship

SIDE = 90


def llc_positions(pos: Column, side: int = SIDE) -> tuple[Column, Column, Column]:
    """tile, j and i of a place in a flat record: tiles 0 to 6 one after another, 7 to 9 and 10 to 12 side by side."""
    size = side * side
    whole = pos < 7 * size
    slab = F.when(pos < 10 * size, F.lit(7)).otherwise(F.lit(10))
    at = pos - slab * size
    tile = F.when(whole, F.floor(pos / size)).otherwise(slab + F.floor(F.pmod(at, F.lit(3 * side)) / side))
    j = F.when(whole, F.floor(F.pmod(pos, F.lit(size)) / side)).otherwise(F.floor(at / (3 * side)))
    i = F.pmod(F.when(whole, pos).otherwise(at), F.lit(side))
    return tile.cast("int"), j.cast("int"), i.cast("int")


CHUNK = 32 << 20  # bytes of a partition, about


class Records(InputPartition):
    """Records first to last (not included) of a file."""

    def __init__(self, path: str, size: int, first: int, last: int):
        self.path, self.size, self.first, self.last = path, size, first, last


class GridReader(DataSourceReader):
    """Reads the files, records and tiles of grid files that the options name, and no other bytes."""

    def __init__(self, options: dict):
        some = lambda name, kind: {kind(x) for x in options[name].split(",")} if options.get(name) else None
        self.root, self.pattern, self.side = options["path"], options.get("pattern", "*.data"), int(options.get("side", SIDE))
        self.kept = {"stem": some("stems", str), "record": some("records", int), "tile": some("tiles", int)}
        self.first, self.last = (int(options[k]) if options.get(k) else None for k in ("first", "last"))

    def fits(self, **known) -> bool:
        """Whether stem, stamp, record or tile, as far as they are given, are among those asked for."""
        if any(self.kept.get(k) is not None and v not in self.kept[k] for k, v in known.items()):
            return False
        at = known.get("stamp")
        return "stamp" not in known or (self.first is None or at is not None and at >= self.first) and (self.last is None or at is not None and at < self.last)

    @staticmethod
    def named(path: str) -> dict:
        """stem: the file's name up to the first dot; stamp: the number of ten digits between dots, if it has one."""
        name = path.rpartition("/")[2]
        digits = re.search(r"\.([0-9]{10})(?=[._])", name)
        return {"path": path, "stem": name.partition(".")[0], "stamp": int(digits[1]) if digits else None}

    def partitions(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        each, out = 13 * self.side**2 * 4, []
        for f in found:
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and self.fits(**{k: v for k, v in self.named(f.path).items() if k != "path"}):
                records = [k for k in range(-(-f.size // each)) if self.fits(record=k)]
                for k in range(0, len(records), step := max(1, CHUNK // each)):
                    some = records[k : k + step]
                    out.append(Records(f.path, f.size, some[0], some[-1] + 1))
        return out or [Records("", 0, 0, 0)]

    def ranges(self, part: Records):
        """(record, tiles, first byte, bytes) of what has to be read: a tile, or a slab of three that lie side by side."""
        size = self.side**2
        for record in range(part.first, part.last):
            if self.fits(record=record):
                for tiles in [(k,) for k in range(7)] + [(7, 8, 9), (10, 11, 12)]:
                    if kept := [t for t in tiles if self.fits(tile=t)]:
                        first = (record * 13 * size + tiles[0] * size) * 4
                        n = min(len(tiles) * size * 4, max(0, part.size - first) // 4 * 4)
                        if n:
                            yield record, kept, first, n

    def read(self, partition: Records):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        if not partition.path:
            return
        files, _ = fs.FileSystem.from_uri(self.root)
        side, known = self.side, self.named(partition.path)
        with files.open_input_file(partition.path) as f:
            for record, tiles, first, n in self.ranges(partition):
                x = np.frombuffer(f.read_at(n, first), ">f4").astype(np.float64)
                at = np.arange(len(x))
                if tiles[0] < 7:
                    tile, j, i = np.full(len(x), tiles[0]), at // side, at % side
                else:
                    tile, j, i = (7 if tiles[0] < 10 else 10) + at % (3 * side) // side, at // (3 * side), at % side
                kept = np.isin(tile, tiles)
                tile, j, i, x = (c[kept] for c in (tile, j, i, x))
                names = [pa.array([known[k]] * len(x), t) for k, t in (("path", pa.string()), ("stem", pa.string()), ("stamp", pa.int64()))]
                yield pa.record_batch([*names, pa.array(np.full(len(x), record, np.int64)), *(pa.array(c.astype(np.int32)) for c in (tile, j, i)), pa.array(x, mask=~np.isfinite(x))], names=["path", "stem", "stamp", "record", "tile", "j", "i", "x"])


class GridFiles(DataSource):
    """``spark.read.format("gridtide_grid")`` with the options path, pattern, side, stems, first, last, records and tiles."""

    @classmethod
    def name(cls) -> str:
        return "gridtide_grid"

    def schema(self) -> str:
        return "path string, stem string, stamp long, record long, tile int, j int, i int, x double"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)


def floats(spark: SparkSession, path: str, pattern: str = "*.data", side: int = SIDE, stems: list[str] | None = None, first: int | None = None, last: int | None = None, records: list[int] | None = None, tiles: list[int] | None = None) -> DataFrame:
    """(path, stem, stamp, record, tile, j, i, x) of the files under path; NaN and infinities become NULL.

    Only files with the stems and with first <= stamp < last are opened, and only the records and tiles asked for are read;
    of tiles 7 to 12 three lie side by side and are read together. Partitions are files, or ranges of their records. path
    is one that pyarrow can open: a folder that driver and executors share, or an object store.

    These are arguments and no pushed filters, since Spark 4.1 keeps filters that were pushed to a Python source for later
    queries on the same DataFrame, which then lose rows.
    """
    joined = lambda some: None if some is None else ",".join(map(str, some))
    options = {"pattern": pattern, "side": side, "stems": joined(stems), "first": first, "last": last, "records": joined(records), "tiles": joined(tiles)}
    ship(spark).dataSource.register(GridFiles)
    return spark.read.format(GridFiles.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def llc_place(tile: Column, j: Column, i: Column, side: int = SIDE) -> Column:
    """The place in a flat record, as :func:`llc_positions` reads it."""
    slab = F.when(tile < 10, F.lit(7)).otherwise(F.lit(10))
    return F.when(tile < 7, (tile * side + j) * side + i).otherwise(slab * side * side + (j * 3 + tile - slab) * side + i)


def write_floats(df: DataFrame, path: str, side: int = SIDE) -> int:
    """Writes df (name, record, tile, j, i, x) as grid files path/name, records from 0 on; gives their number.

    Each file is written by one task in order of its records, one record held at a time, and moved to its name when it is
    whole, so a task that runs again replaces it. Points without a row or a value are NaN, records between others too.
    """
    import numpy as np
    import pyarrow as pa

    size = 13 * side * side

    def task(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        held = {"name": None}

        def closed():
            if held["name"] is not None:
                held["out"].write(held["record"].astype(">f4").tobytes())
                held["out"].close()
                files.move(held["part"], f"{root}/{held['name']}")

        done = 0
        for batch in batches:
            names, records, places, values = (batch.column(k) for k in range(4))
            records, places, values = records.to_numpy(), places.to_numpy(), values.to_numpy(zero_copy_only=False)
            names = np.array(names.to_pylist(), object)
            cut = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (records[1:] != records[:-1])))) if len(names) else []
            for a, z in zip(cut, [*cut[1:], len(names)], strict=True):
                if names[a] != held["name"]:
                    closed()
                    part = f"{root}/.{names[a]}.{np.random.default_rng().integers(1 << 62):x}"
                    held = {"name": names[a], "part": part, "out": files.open_output_stream(part), "record": np.full(size, np.nan), "at": 0}
                    done += 1
                while held["at"] < records[a]:
                    held["out"].write(held["record"].astype(">f4").tobytes())
                    held |= {"record": np.full(size, np.nan), "at": held["at"] + 1}
                held["record"][places[a:z]] = values[a:z]
        closed()
        yield pa.record_batch([pa.array([done], pa.int64())], names=["files"])

    rows = df.select("name", F.col("record").cast("long").alias("record"), llc_place(F.col("tile"), F.col("j"), F.col("i"), side).cast("long").alias("at"), F.col("x").cast("double").alias("x"))
    rows = rows.repartition("name").sortWithinPartitions("name", "record")
    return rows.mapInArrow(task, "files long").agg(F.sum("files")).first()[0] or 0


def sensitivities(spark: SparkSession, path: str, last_day: int, side: int = SIDE, pattern: str = "adxx_*.data") -> DataFrame:
    """(forc, step, s, tile, j, i, x): smoothed records of files adxx_<forc>.*, a week apart up to last_day (since 1970)."""
    from pyspark.sql import Window

    from gridtide.operators.resample import smoothed

    rows = floats(spark, path, pattern, side).withColumn("forc", F.regexp_extract("stem", r"adxx_([^./]+)$", 1))
    rows = smoothed(rows, ["forc", "tile", "j", "i"], "record")
    last = F.max("record").over(Window.partitionBy("forc", "tile", "j", "i"))
    s = (F.lit(last_day) * 86400 - 302400 - (last - F.col("record")) * 604800).cast("long")
    return rows.select("forc", F.col("record").alias("step"), s.alias("s"), "tile", "j", "i", F.col("smooth").alias("x"))


def sensitivities_of_many_years(spark: SparkSession, path: str, side: int = SIDE) -> DataFrame:
    """As :func:`sensitivities`, of the one file a forcing that reaches back from 2016-01-06 to 1992."""
    return sensitivities(spark, path, 16806, side, "adxx_*.0000000059_dim.data")


def weekly_forcing(spark: SparkSession, path: str, side: int = SIDE, forcings: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(forc, s, tile, j, i, x) of files <forc>.<hours since 1992-01-01, plus 84>.data; a missing week has no rows.

    Only the files of ``forcings`` and of weeks with first <= s < last are opened.
    """
    hours = lambda s: None if s is None else -(-(s - 694224000) // 3600) + 84
    rows = floats(spark, path, "*.data", side, stems=forcings, first=hours(first), last=hours(last)).where("stamp is not null")
    return rows.select(F.col("stem").alias("forc"), (F.lit(694224000) + (F.col("stamp") - 84) * 3600).alias("s"), "tile", "j", "i", "x")


def mask(spark: SparkSession, path: str, pattern: str = "*.data", side: int = SIDE, tiles: list[int] | None = None) -> DataFrame:
    """(tile, j, i, share) of the points of a region mask that are not zero."""
    return floats(spark, path, pattern, side, tiles=tiles).where("x <> 0").select("tile", "j", "i", F.col("x").alias("share"))
