"""TIFF stacks as a Spark data source, format "tiff_stack": stacks are written page by page and read by ranges of pages.

Writing takes rows (name, z, spots) in which the pages of a stack lie together in one partition in the order of z; see
write_stacks. A task streams its stacks into a folder of its own, blank pages between included, so it holds one page. Once
all tasks have ended the driver moves the files to their names; where one failed nothing is left. Options: tissue
(sizes along x, y, z), bigtiff (true for stacks beyond 4 GB).

Reading gives (volume_id, z, y, x, value): a file's name, its page, row, column and number. The driver walks a file's
chain of page directories, and a task reads a range of pages, so a file of many pages is many tasks' work. Of more than FEW
files only those beyond GROUP bytes are walked so; the others are dealt to tasks whole, many to a task, and their chains are
the tasks' work. Pages may be in
either byte order, BigTIFF, in strips or tiles, raw, deflated or PackBits, of whole or floating numbers, one sample a pixel.
Options: pages (of a task), only (a number: places that hold it), limits (true: a row for each page with its least and largest number, NaN
where it holds one: volume_id, lo, hi).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .reports import output_name

#: Numbers of the TIFF tags in use.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
#: Letters and sizes of the types of tag values.
KINDS = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("Q", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
SCHEMA = "volume_id string, z int, y int, x int, value double"
LIMITS = "volume_id string, lo double, hi double"
PAGES = 16
#: Files up to which all are read by ranges of pages; bytes of whole files that a task takes where there are more.
FEW, GROUP = 64, 32 << 20


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- layout


class Layout:
    """Where things stand in a little-endian stack of equal 8-bit pages: data, then directory, page after page."""

    def __init__(self, pages: int, rows: int, columns: int, big: bool = False):
        self.pages, self.rows, self.columns, self.big = pages, rows, columns, big
        self.head, self.own = (16, 8 + 20 * 10 + 8) if big else (8, 2 + 12 * 10 + 4)
        self.data = rows * columns + rows * columns % 2
        if not big and self.head + pages * (self.data + self.own) >= 1 << 32:
            raise ValueError("a stack beyond 4 GB needs the option bigtiff")

    def directory(self, page: int) -> int:
        return self.head + page * (self.data + self.own) + self.data

    def header(self) -> bytes:
        first = self.directory(0) if self.pages else 0
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if self.big else struct.pack("<2sHI", b"II", 42, first)

    def page(self, number: int, data: bytes) -> bytes:
        """A page's data and directory."""
        at = self.directory(number) - self.data
        tags = [(WIDTH, self.columns), (LENGTH, self.rows), (BITS, 8), (COMPRESSION, 1), (PHOTOMETRIC, 1), (OFFSETS, at), (SAMPLES, 1), (ROWS, self.rows), (COUNTS, len(data)), (FORMAT, 2)]
        after = self.directory(number + 1) if number + 1 < self.pages else 0
        count, entry, link = ("<Q", "<HHQQ", "<Q") if self.big else ("<H", "<HHII", "<I")
        listed = b"".join(struct.pack(entry, t, 16 if self.big else 4, 1, v) for t, v in tags)
        return data + b"\x00" * (self.data - len(data)) + struct.pack(count, len(tags)) + listed + struct.pack(link, after)


# --- writing


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class StackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, tissue: tuple[int, int, int], big: bool, overwrite: bool):
        self.path, self.tissue, self.big, self.overwrite = path.rstrip("/"), tissue, big, overwrite
        self.own = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.own)
        t0, t1, t2 = self.tissue
        layout = Layout(t2, t0, t1, self.big)
        blank = bytes(t0 * t1)
        folder = f"{root}/{uuid.uuid4().hex}"
        fs.create_dir(folder)
        done: list[tuple[str, str]] = []
        out, name, z = None, None, 0

        def closed() -> None:
            if out is not None:
                for k in range(z, t2):
                    out.write(layout.page(k, blank))
                out.close()

        for batch in iterator:
            spots = batch.column("spots")
            for k, (stack, page) in enumerate(zip(batch.column("name").to_pylist(), batch.column("z").to_pylist())):
                if stack != name:
                    closed()
                    if any(stack == n for n, _ in done):
                        raise ValueError(f"the pages of {stack} don't lie together")
                    name, z = stack, 0
                    done.append((name, f"{folder}/{name}"))
                    out = fs.open_output_stream(f"{folder}/{name}")
                    out.write(layout.header())
                if page is None:
                    continue
                if not z <= page < t2:
                    raise ValueError(f"page {page} of {stack} is out of order or beyond {t2} pages")
                for blank_page in range(z, page):
                    out.write(layout.page(blank_page, blank))
                plane = np.zeros(t0 * t1, dtype=np.int8)
                plane[spots[k].values.to_numpy(zero_copy_only=False)] = -1
                out.write(layout.page(page, plane.tobytes()))
                z = page + 1
        closed()
        return Written(tuple(done))

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        _, own = opened(self.own)
        files = [f for m in messages if m is not None for f in m.files]
        if len({n for n, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("the pages of a stack were dealt to several tasks")
        if self.overwrite:
            new = {n for n, _ in files}
            for name in stacks_in(self.path):
                if name not in new:
                    fs.delete_file(f"{root}/{name}")
        for name, at in files:
            fs.move(at, f"{root}/{name}")
        fs.delete_dir(own)

    def abort(self, messages: list) -> None:
        fs, own = opened(self.own)
        fs.delete_dir_contents(own, missing_dir_ok=True)
        fs.delete_dir(own)


def stacks_in(path: str) -> dict[str, int]:
    """Names of the stacks in a folder (nothing in its folders counts), in order, and their sizes; of a file, itself."""
    from pyarrow import fs as kinds

    fs, root = opened(path)
    own = fs.get_file_info(root)
    if own.is_file:
        return {own.base_name: own.size}
    found = fs.get_file_info(kinds.FileSelector(root, allow_not_found=True))
    return dict(sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.lower().endswith((".tif", ".tiff"))))


# --- reading


class Chain:
    """A TIFF file's byte order and page directories."""

    def __init__(self, source):
        self.source = source
        head = self.bytes(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        kind = struct.unpack(self.order + "H", head[2:4])[0] if self.order else 0
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = kind == 43
        self.first = self.unpack("Q", head, 8)[0] if self.big else self.unpack("I", head, 4)[0]

    def bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def unpack(self, letters: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.order + letters, data, at)

    def directory(self, at: int) -> tuple[bytes, int, int]:
        """A directory's entries, their number and the place of the next directory."""
        count, size, link = ("Q", 20, 8) if self.big else ("H", 12, 4)
        n = self.unpack(count, self.bytes(at, struct.calcsize(count)))[0]
        data = self.bytes(at + struct.calcsize("<" + count), n * size + link)
        return data, n, self.unpack("Q" if self.big else "I", data, n * size)[0]

    def places(self) -> Iterator[int]:
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise ValueError("a page directory that follows itself")
            seen.add(at)
            yield at
            at = self.directory(at)[2]

    def tags(self, at: int) -> dict[int, tuple]:
        data, n, _ = self.directory(at)
        size, room = (20, 8) if self.big else (12, 4)
        found = {}
        for i in range(n):
            tag, kind = self.unpack("HH", data, i * size)
            number = self.unpack("Q" if self.big else "I", data, i * size + 4)[0]
            letter, width = KINDS.get(kind, ("B", 1))
            value = data[i * size + size - room : (i + 1) * size]
            if number * width > room:
                value = self.bytes(self.unpack("Q" if self.big else "I", value)[0], number * width)
            found[tag] = self.unpack(f"{number}{letter}", value)
        return found

    def page(self, at: int) -> np.ndarray:
        """The numbers of a page (row, column)."""
        tags = self.tags(at)
        one = lambda tag, usual: tags.get(tag, (usual,))[0]
        if one(SAMPLES, 1) != 1:
            raise ValueError("pages with several samples a pixel are not read")
        bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        if bits not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits < 32):
            raise ValueError(f"numbers of {bits} bits are not read")
        dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        rows, columns = tags[LENGTH][0], tags[WIDTH][0]
        out = np.zeros((rows, columns), dtype=dtype.newbyteorder("="))
        tiled = TILE_OFFSETS in tags
        high, wide = (tags[TILE_LENGTH][0], tags[TILE_WIDTH][0]) if tiled else (min(one(ROWS, rows), rows), columns)
        across = -(-columns // wide)
        for k, (place, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])):
            y, x = k // across * high, k % across * wide
            tall = high if tiled else min(high, rows - y)
            data = inflated(self.bytes(place, size), one(COMPRESSION, 1), tall * wide * dtype.itemsize)
            block = np.frombuffer(data, dtype=dtype, count=tall * wide).reshape(tall, wide).astype(out.dtype)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            elif one(PREDICTOR, 1) != 1:
                raise ValueError("pages with this predictor are not read")
            out[y : y + tall, x : x + wide] = block[: rows - y, : columns - x]
        return out


def inflated(data: bytes, method: int, size: int) -> bytes:
    if method == 1:
        return data
    if method in (8, 32946):
        return zlib.decompress(data)
    if method != 32773:
        raise ValueError(f"compression {method} is not read")
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


@dataclass
class PageRange(InputPartition):
    path: str
    name: str
    first: int
    places: tuple[int, ...]


@dataclass
class Files(InputPartition):
    """Whole files of a folder."""

    root: str
    names: tuple[str, ...]


def dealt(sizes: dict[str, int]) -> tuple[list[tuple[str, ...]], list[str]]:
    """Groups of files that are read whole, and the files that are read by ranges of pages."""
    if len(sizes) <= FEW:
        return [], list(sizes)
    small = {n: size for n, size in sizes.items() if size <= GROUP}
    most = min(GROUP, sum(small.values()) // FEW + 1)
    groups, own, total = [], [], 0
    for name, size in small.items():
        if own and total + size > most:
            groups.append(tuple(own))
            own, total = [], 0
        own.append(name)
        total += size
    return groups + ([tuple(own)] if own else []), [n for n in sizes if n not in small]


class StackReader(DataSourceReader):
    def __init__(self, path: str, pages: int, only: float | None = None, limits: bool = False):
        self.path, self.pages, self.only, self.limits = path, pages, only, limits

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).is_file:
            groups, walked = [], [root]
        else:
            groups, walked = dealt(stacks_in(self.path))
            walked = [f"{root}/{n}" for n in walked]
        out: list[InputPartition] = [Files(root, names) for names in groups]
        for path in walked:
            with fs.open_input_file(path) as source:
                places = list(Chain(source).places())
            out += [PageRange(path, path.rsplit("/", 1)[-1], k, tuple(places[k : k + self.pages])) for k in range(0, len(places), self.pages)]
        return out or [PageRange("", "", 0, ())]

    def pages_of(self, partition: InputPartition) -> Iterator[tuple[str, int, np.ndarray]]:
        """Names, numbers and pages of a partition."""
        fs, _ = opened(self.path)
        if isinstance(partition, Files):
            for name in partition.names:
                with fs.open_input_file(f"{partition.root}/{name}") as source:
                    chain = Chain(source)
                    for z, at in enumerate(chain.places()):
                        yield name, z, chain.page(at)
        elif partition.places:
            with fs.open_input_file(partition.path) as source:
                chain = Chain(source)
                for z, at in enumerate(partition.places, partition.first):
                    yield partition.name, z, chain.page(at)

    def read(self, partition: PageRange) -> Iterator:
        import pyarrow as pa

        for name, z, page in self.pages_of(partition):
            value = page.astype(np.float64)
            if self.limits:
                if page.size:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([value.min()]), pa.array([value.max()])], names=["volume_id", "lo", "hi"])
                continue
            if self.only is None:
                y, x = (at.ravel() for at in np.indices(page.shape, dtype=np.int32))
                value = value.ravel()
            else:
                y, x = (at.astype(np.int32) for at in np.nonzero(value == self.only))
                value = np.full(len(y), self.only)
            n = len(value)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), pa.array([name])).dictionary_decode()
            columns = [names, *map(pa.array, (np.full(n, z, dtype=np.int32), y, x, value))]
            yield pa.RecordBatch.from_arrays(columns, names=["volume_id", "z", "y", "x", "value"])


class StackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return LIMITS if self._limits() else SCHEMA

    def _limits(self) -> bool:
        return self.options.get("limits", "false").lower() == "true"

    def reader(self, schema) -> StackReader:
        only = self.options.get("only")
        return StackReader(self.options["path"], int(self.options.get("pages", PAGES)), None if only is None else float(only), self._limits())

    def writer(self, schema, overwrite: bool) -> StackWriter:
        missing = {"name", "z", "spots"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"stacks are written from name, z and spots; missing: {sorted(missing)}")
        tissue = tuple(int(t) for t in self.options["tissue"].split(","))
        return StackWriter(self.options["path"], tissue, self.options.get("bigtiff", "false").lower() == "true", overwrite)


# --- with voxels


def write_stacks(voxels: DataFrame, params: DataFrame, path: str, tissue: tuple[int, int, int], big: bool = False, mode: str = "overwrite") -> None:
    """A stack for every network of params (network_id, n), blank ones included, named by both: pages z of rows x and
    columns y, a voxel being 255 as a signed byte."""
    voxels.sparkSession.dataSource.register(StackSource)
    spot = (F.col("x") * tissue[1] + F.col("y")).cast("int")
    planes = voxels.groupBy("network_id", F.col("z").cast("int").alias("z")).agg(F.collect_list(spot).alias("spots"))
    names = params.select("network_id", output_name(F.col("n"), F.col("network_id")).alias("name"))
    # Spark takes planes for as small as params and would broadcast them. The merge join leaves a network's pages in one task.
    rows = names.join(planes.hint("merge"), "network_id", "left").select("name", "z", "spots").sortWithinPartitions("name", "z")
    rows.write.format("tiff_stack").mode(mode).option("tissue", ",".join(map(str, tissue))).option("bigtiff", str(big).lower()).save(path)


def read_stacks(spark: SparkSession, path: str, pages: int = PAGES, only: float | None = None) -> DataFrame:
    """volume_id, z, y, x and value of the stacks in a folder, or of one, as they are stored; only: of places with this value."""
    spark.dataSource.register(StackSource)
    rows = spark.read.format("tiff_stack").option("pages", str(pages))
    return (rows if only is None else rows.option("only", repr(float(only)))).load(path)


def read_limits(spark: SparkSession, path: str, pages: int = PAGES) -> DataFrame:
    """volume_id, lo and hi of every page of the stacks in a folder, or of one."""
    spark.dataSource.register(StackSource)
    return spark.read.format("tiff_stack").option("pages", str(pages)).option("limits", "true").load(path)
