"""What the files of an input are: encoding, delimiter, quoting, size and digest.

Each probe scans physical lines and folds them per split, so a single huge file is spread over its splits
and only one row for each of them leaves a task. The SHA-256 of a file is one chain over its bytes: a large
file is cut into steps, one task takes the digest through one step, and hands its state to the next.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import importlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveframe.session import scratch_folder
from sieveframe.sources.records import DELIMITERS, UTF8, UTF16, WINDOWS, fold_splits, placed_splits, raw_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

DIGEST_LIMIT = 2**31 - 1024  # the binary reader holds one file in one array; larger ones are read in blocks
DIGEST_BLOCK = 8 * 1024**2
DIGEST_STEP = 256 * 1024**2  # files above it are digested in steps of as many bytes, and of whole splits
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"  # Spark's text reader would decompress these
PIECE = 1024**2
LONGEST_LINE = 64 * 1024**2  # a file with a longer one is not cut into steps
# Parquet looks at its size after 100 rows, that is after 100 pieces, unless told otherwise.
SCRATCH = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": 16 * 1024**2,
           "parquet.block.size.row.check.min": 4, "parquet.block.size.row.check.max": 4, "parquet.page.size.row.check.min": 1}
BYTE_ORDER_MARK = b"\xef\xbb\xbf"  # left out by the text reader at the start of a file

PIECES = "path string, block long, at long, size long, piece binary"
STATES = "path string, length long, number int, done long, state binary, sha256 string"


def _binary(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)


def encoding_of(charset: Column, valid: Column) -> Column:
    """The encoding of a file by the mark it starts with and by whether all of it is UTF-8."""
    return F.when(charset.isNotNull(), UTF16).when(valid, UTF8).otherwise(WINDOWS)


def probe_files(spark: SparkSession, glob: str) -> DataFrame:
    """One row per file: ``path, length, encoding, first_line, delimiter, open_lines, quotes, blank_lines, odd_lines, unclosed``.

    The delimiter is the candidate that cuts most records of the first 64 KiB alike. With it, ``open_lines``
    counts physical lines that end inside a quoted field: more than none means that cells hold line breaks. A
    quote within an unquoted field is plain text. ``odd_lines`` have text after a closing quote; ``unclosed``
    files end inside a quoted field. Of UTF-16 files only encoding, first line and delimiter are told. Files
    of zero length hold no line and are not listed.
    """
    splits = fold_splits(raw_lines(spark, glob))
    named = splits.withColumn("delimiter", F.max("delimiter").over(Window.partitionBy("path")))
    own = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter")).cast("int") - 1
    placed = placed_splits(named, own)
    found = placed.groupBy("path", "length").agg(
        F.max("first_line").alias("head"), F.max("charset").alias("charset"), F.bool_and("valid").alias("valid"), F.max("delimiter").alias("delimiter"),
        F.sum("open_lines").alias("open_lines"), F.sum("quotes").alias("quotes"), F.sum("blanks").alias("blank_lines"),
        F.sum("odd_lines").alias("odd_lines"), F.max_by("ends_inside", "block").alias("unclosed"))
    encoding = encoding_of(F.col("charset"), F.col("valid"))
    first = F.when(encoding == WINDOWS, F.decode("head", "ISO-8859-1")).otherwise(F.decode("head", "UTF-8"))
    return found.select("path", "length", encoding.alias("encoding"), first.alias("first_line"), "delimiter", "open_lines",
                        "quotes", "blank_lines", "odd_lines", "unclosed")


def likely_delimiter(line: Column) -> Column:
    """The candidate seen most often in ``line``; the earlier candidate wins a tie."""
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    return F.coalesce(*[F.when(n == most, d) for n, d in zip(counts, DELIMITERS)])


def file_encodings(spark: SparkSession, glob: str) -> DataFrame:
    return probe_files(spark, glob).select("path", "encoding")


def file_delimiters(spark: SparkSession, glob: str) -> DataFrame:
    return probe_files(spark, glob).select("path", "delimiter")


def unclosed_quotes(spark: SparkSession, glob: str) -> DataFrame:
    """Files in which a quote opens a field and is never closed."""
    return probe_files(spark, glob).filter("unclosed").select("path", "quotes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for uri in batch.column("path").to_pylist():
            files, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
            digest = hashlib.sha256()
            with files.open_input_stream(path) as stream:
                while block := stream.read(DIGEST_BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], ["path", "length", "sha256"])


def _openssl() -> ctypes.CDLL | None:
    """The library that ``hashlib`` itself calls, if it names its SHA-256 functions."""
    for find in (lambda: importlib.import_module("_hashlib").__file__, lambda: ctypes.util.find_library("crypto")):
        try:
            library = ctypes.CDLL(find() or "")
            if library.SHA256_Init and library.SHA256_Update and library.SHA256_Final:
                return library
        except (ImportError, OSError, AttributeError):
            continue
    return None


class Sha256:
    """SHA-256 that can hand on its state, which that of ``hashlib`` cannot: OpenSSL's ``SHA256_CTX`` as bytes."""

    SIZE = 112

    def __init__(self, state: bytes | None = None):
        self.library = _openssl()
        if self.library is None:
            raise RuntimeError("Python's OpenSSL does not name SHA256_Init, SHA256_Update and SHA256_Final")
        self.context = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self.library.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.context, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        found, last = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.context.raw, self.SIZE)
        self.library.SHA256_Final(found, last)
        return found.raw.hex()


def hands_on_state() -> bool:
    """Whether ``Sha256`` works here, by a digest in two parts."""
    try:
        first = Sha256()
        first.update(b"x" * 100)
        second = Sha256(first.state())
        second.update(b"y" * 100)
        return second.hexdigest() == hashlib.sha256(b"x" * 100 + b"y" * 100).hexdigest()
    except RuntimeError:
        return False


def _pieces(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """The lines of each split of a file put together in order, in rows of some ``room`` bytes."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("piece", pa.binary())])
    split, at, parts, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"path": split[0], "block": split[1], "at": at, "size": size, "piece": b"".join(parts)}], schema)

    for batch in batches:
        paths, blocks, lines = batch.column("path"), batch.column("block"), batch.column("line")
        changes = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        starts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:]):
            if start == end:
                continue
            here = paths[start].as_py(), blocks[start].as_py()
            if here != split:
                if size:
                    yield row()
                split, at, parts, size = here, 0, [], 0
            parts.append(pc.binary_join(pa.ListArray.from_arrays([0, end - start], lines.slice(start, end - start)), b"")[0].as_py())
            size += len(parts[-1])
            if size >= room:
                yield row()
                at, parts, size = at + 1, [], 0
    if size:
        yield row()


def _advance(batches: Iterator[pa.RecordBatch], last: bool, in_steps: bool) -> Iterator[pa.RecordBatch]:
    """Takes the state of each file, the first of its rows, through the pieces that follow it in order."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("number", pa.int32()), ("done", pa.int64()),
                        ("state", pa.binary()), ("sha256", pa.string())])
    file, digest = None, None

    def row() -> pa.RecordBatch:
        ended = file["done"] == file["length"]
        if last and not ended:
            raise ValueError(f"{file['path']}: {file['done']} of {file['length']} bytes read")
        return pa.RecordBatch.from_pylist([{**file, "state": None if ended else digest.state(),
                                            "sha256": digest.hexdigest() if ended else None}], schema)

    for batch in batches:
        for k in range(batch.num_rows):
            piece = batch.column("piece")[k].as_py()
            if batch.column("block")[k].as_py() < 0:
                if file:
                    yield row()
                file = {name: batch.column(name)[k].as_py() for name in ("path", "length", "number", "done")}
                digest = Sha256(batch.column("state")[k].as_py()) if in_steps else hashlib.sha256()
            elif batch.column("path")[k].as_py() != file["path"]:
                raise ValueError(f"{batch.column('path')[k].as_py()}: no state")
            if piece:
                piece = piece[:file["length"] - file["done"]]  # the line end that the last line may not have
                digest.update(piece)
                file["done"] += len(piece)
    if file:
        yield row()


def _in_steps(spark: SparkSession, glob: str, large: DataFrame, above: int, step: int) -> tuple[DataFrame | None, list[str]]:
    """``path, length, sha256`` of the files ``large``, ``above`` that size, and the paths of those that lines of bounded length do not give whole.

    Tasks read splits and write their bytes under the scratch folder, by step. Then there is a job for each step,
    in which one task for each file that goes on reads the bytes of that step and the state the last one left.
    Without a library that hands on a state there is only one step.
    """
    in_steps = hands_on_state()
    last_step = F.floor((F.col("length") - 1) / step).cast("long") if in_steps else F.lit(0)
    ends = dict(large.groupBy(last_step.alias("step")).count().collect())
    if not ends:
        return None, []
    folder = scratch_folder(spark, "digest")
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    lines = reader.option("mapreduce.input.linerecordreader.line.maxlength", LONGEST_LINE).text(glob).filter(
        (F.col("_metadata.file_size") > above) & ~F.col("_metadata.file_path").rlike(PACKED))
    # The reader drops a longer line or cuts it; what it cut is dropped here, so that the sizes tell.
    lines.filter(F.octet_length("value") < LONGEST_LINE - 4) \
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("line")) \
        .mapInArrow(lambda batches: _pieces(batches, PIECE), PIECES) \
        .withColumn("step", F.floor(F.col("block") / step).cast("long") if in_steps else F.lit(0).cast("long")) \
        .write.options(**SCRATCH).partitionBy("step").parquet(f"{folder}/pieces")
    pieces = spark.read.schema(f"{PIECES}, step long").parquet(f"{folder}/pieces")

    # What the lines do not hold: the mark before them. They may hold one line end too many.
    short = F.col("length") - F.coalesce(F.col("found"), F.lit(0))
    number = (F.row_number().over(Window.orderBy(F.desc("length"), "path")) - 1).cast("int")
    large.join(pieces.groupBy("path").agg(F.sum("size").alias("found")), "path", "left").select(
        "path", "length", number.alias("number"), F.lit(0).cast("long").alias("done"), F.lit(None).cast("binary").alias("state"),
        F.lit(None).cast("string").alias("sha256"), F.when(short.isin(2, 3), F.lit(BYTE_ORDER_MARK)).otherwise(F.lit(b"")).alias("piece"),
        short.isin(-1, 0, 2, 3).alias("whole")).write.parquet(f"{folder}/files")
    found = spark.read.schema(f"{STATES}, piece binary, whole boolean").parquet(f"{folder}/files")
    files, rest = found.where("whole"), [r["path"] for r in found.where("not whole").select("path").collect()]

    states = files
    for k in range(max(ends) + 1):
        going = sum(count for end, count in ends.items() if end >= k)
        before = states.where("sha256 is null").select(
            "path", "length", "number", "done", "state", "piece" if k == 0 else F.lit(None).cast("binary").alias("piece"),
            F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("at"))
        here = pieces.where(F.col("step") == k).join(files.select("path", "number"), "path")
        rows = before.unionByName(here.drop("size", "step"), allowMissingColumns=True)
        rows.repartitionById(going, "number").sortWithinPartitions("number", "block", "at").mapInArrow(
            lambda batches, last=k == max(ends): _advance(batches, last, in_steps), STATES).write.parquet(f"{folder}/states/{k}")
        states = spark.read.schema(STATES).parquet(f"{folder}/states/{k}")
    every = spark.read.schema(STATES).parquet(*[f"{folder}/states/{k}" for k in range(max(ends) + 1)])
    return every.where("sha256 is not null").select("path", "length", "sha256"), rest


def manifest(spark: SparkSession, glob: str, step: int = DIGEST_STEP) -> DataFrame:
    """``path, length, sha256`` per file, the digest of all its bytes whatever its size.

    Files above ``step`` are read in splits and digested in steps, so that no task reads or holds one whole. Packed
    files, which Spark reads unpacked or as one array, and those with a line above 64 MiB are read by one task; above
    2 GiB in blocks by Arrow's file systems.
    """
    def files(condition: Column) -> DataFrame:
        return _binary(spark, glob).filter(condition)

    path, above = F.col("_metadata.file_path"), min(step, DIGEST_LIMIT)
    packed, small = path.rlike(PACKED), F.col("_metadata.file_size") <= above
    stepped, rest = _in_steps(spark, glob, files(~small & ~packed).select(path.alias("path"), "length"), above, step)
    apart = packed | path.isin(rest) if rest else packed
    hashed = files((F.col("length") <= DIGEST_LIMIT) & (small | apart)).select(path.alias("path"), "length", F.sha2("content", 256).alias("sha256"))
    large = files((F.col("length") > DIGEST_LIMIT) & apart).select(path.alias("path"), "length")
    found = hashed.unionByName(large.mapInArrow(_digests, "path string, length long, sha256 string"))
    return found if stepped is None else found.unionByName(stepped)
