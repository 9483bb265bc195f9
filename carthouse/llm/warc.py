"""Operator 1, a deterministic sharded WARC writer and its reader.

Records are range-sorted by id and payload digest into shards of about equal
bytes, each shard is a task that is written in order and rolled into files by
compressed size, every header and digest is generated
anew, and files appear under their final names only after the manifest of the
winning task attempts is committed: tasks write temporary names, Spark commits
the manifest table, and a second, repeatable job renames what it lists. The
same rows give byte-identical files on every run and every cluster.

Of records with equal payloads of at least ``revisit_bytes`` the one with the
largest id is the response and the others revisit it.

Defined cases: a null payload is empty; a record without a URL has no
WARC-Target-URI, and characters no header may hold are percent-encoded; rows
without an id come first, carry no id, and revisit a row that has one; of repeated rows (same id and
payload) one is the response and the others revisit that id; an empty table
writes an empty manifest and reads back as no rows; other columns are ignored.

The reader reads the files the manifest lists, one a task, and compares each
one's size, SHA-256 and number of records with it: an archive that is gone, cut
short or altered fails the read. Files are written and read from tasks through
``pyarrow.fs`` (file, hdfs, s3 and gs addresses).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carthouse.llm.common import bounded_batches, join_by_class, scratch_path, stage

#: Payload bytes of one shard and compressed bytes at which a file is rolled.
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
#: Ids and digests fetched to place the shard bounds (about; a hash decides which).
BOUND_SAMPLE = 100_000
#: What a record's headers add to its payload, about.
HEADER_BYTES = 600
#: Shards share tasks beyond this many.
MAX_TASKS = 20_000
#: The date written to every record: archives must not depend on the clock.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_NAMES = uuid.UUID("8f7b2a52-53c8-5a0e-9b58-0d6a2a8f61c4")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "shard long, part int, name string, temporary string, records long, bytes long, sha256 string"


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time stamp."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE),
             ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
             ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def _uri(url: str) -> str:
    return quote(url, safe="%!#$&'()*+,/:;=?@[]~-._|^`{}\"<>\\")


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes,
                refers: tuple[int, str | None] | None) -> bytes:
    """The WARC record of one page: a response, or a revisit of ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    name = base64.b32encode(digest).decode()
    headers = [("WARC-Record-ID", _urn(f"{page_id}/{name}/{'revisit' if refers else 'response'}"))]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + name)]
    if refers is None:
        return _member("response", headers, http.encode() + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(f"{refers[0]}/{name}/response")),
                ("X-Refers-To-Page-Id", str(refers[0]))]
    if refers[1] is not None:
        headers.append(("WARC-Refers-To-Target-URI", _uri(refers[1])))
    return _member("revisit", headers, http.encode())


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, pieces = zlib.decompressobj(wbits=31), []
        while not one.eof and at < len(view):  # fed in steps: what follows the member is never copied whole
            step = view[at:at + (1 << 14)]
            pieces.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        raw = b"".join(pieces)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        n = int(fields["content-length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("the record's length does not fit its block")
        if fields.get("warc-block-digest") != "sha1:" + base64.b32encode(hashlib.sha1(rest[:n]).digest()).decode():
            raise ValueError("the record's block does not fit its digest")
        yield fields, rest[:n]


class _Shard:
    """Writes one shard's records in order, rolling files by compressed size."""

    def __init__(self, root: str, shard: int, roll: int):
        from pyarrow.fs import FileSystem
        self.fs, self.root = FileSystem.from_uri(root)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temporary = f".{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}")
        self.size, self.count, self.sha = 0, 0, hashlib.sha256()
        block = b"software: carthouse\r\nformat: WARC File Format 1.1\r\n"
        self._put(_member("warcinfo", [("WARC-Record-ID", _urn(self.name)), ("WARC-Filename", self.name),
                                       ("Content-Type", "application/warc-fields")], block))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is not None and self.count and self.size + len(data) > self.roll:
            yield self.close()
        if self.out is None:
            self._open()
        self._put(data)
        self.count += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.part += 1
        return (self.shard, self.part - 1, self.name, self.temporary, self.count, self.size, self.sha.hexdigest())


def _writer(root: str, roll: int, revisit_bytes: int):
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def write(batches):
        open_, page, links, answered = None, object(), {}, set()
        for b in batches:
            cols = [b.column(n) for n in ("shard", "id", "kind", "url", "payload", "digest", "to", "to_url")]
            for i in range(b.num_rows):
                shard, id_, kind, url, payload, digest, to, to_url = (c[i].as_py() for c in cols)
                if id_ != page:
                    page, links, answered = id_, {}, set()
                if kind == 0:  # what this id's payload refers to; comes before its records
                    links[digest] = (to, to_url)
                    continue
                if open_ is None or open_.shard != shard:
                    if open_ is not None:
                        yield batch([open_.close()])
                    open_ = _Shard(root, shard, roll)
                payload = payload or b""
                sha = hashlib.sha1(payload).digest()
                refers = links.get(sha.hex())
                if refers and refers[0] == id_ and sha not in answered:
                    answered.add(sha)
                    refers = None
                rolled = list(open_.add(page_record(id_, url, payload, sha, refers)))
                if rolled:
                    yield batch(rolled)
        if open_ is not None:
            yield batch([open_.close()])

    return write


def _renamer(root: str):
    def rename(batches):
        from pyarrow.fs import FileSystem, FileType
        fs, base = FileSystem.from_uri(root)
        for b in batches:
            for name, temporary in zip(b.column("name").to_pylist(), b.column("temporary").to_pylist()):
                if fs.get_file_info(f"{base}/{temporary}").type == FileType.File:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type != FileType.File:
                    raise FileNotFoundError(f"{base}/{temporary}")
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    return rename


def commit(spark: SparkSession, root: str) -> DataFrame:
    """Give the files of the committed manifest their final names. May be run
    again after a failure: what is already renamed is left alone."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    manifest.select("name", "temporary").mapInArrow(_renamer(root), "name string") \
        .write.mode("overwrite").parquet(f"{root}/committed")
    return manifest


def _uri_of(root: str) -> str:
    """An address that Spark and pyarrow read alike."""
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return root.replace("file:///", "file:/").replace("file:/", "file:///")


def _bounds(slim: DataFrame, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """First (id, digest) of every shard but the first, at equal steps of the sampled records' bytes.

    Ids compare as numbers, a missing one first; of the digest the first 32 bits count. So neither
    rows without an id nor repeated ids fill a shard, only copies of one payload under one id."""
    thin = max(1, rows // BOUND_SAMPLE)
    head = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    sampled = slim.where(F.pmod(F.xxhash64("id", "digest"), F.lit(thin)) == 0).groupBy(
        F.coalesce("id", F.lit(np.iinfo(np.int64).min)).alias("id"), head.alias("head")).agg(
        F.sum(F.col("n") + HEADER_BYTES).alias("n")).toArrow().sort_by([("id", "ascending"), ("head", "ascending")])
    ids, heads, size = (np.asarray(sampled.column(c)) for c in ("id", "head", "n"))
    upto = np.cumsum(size)
    if not len(upto):
        return ids, heads
    at = np.unique(np.searchsorted(upto - size, upto[-1] * np.arange(1, shards) / shards))
    at = at[(at > 0) & (at < len(ids))]
    return ids[at], heads[at]


def _shard_of(ids: pa.Array, digests: pa.Array, first_ids: np.ndarray, first_heads: np.ndarray) -> np.ndarray:
    """The number of bounds at or before each (id, digest)."""
    known = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
    heads = np.array([int(d[:8], 16) for d in digests.to_pylist()], dtype=np.uint64)
    # An id's place among the bounds' ids, then the digest among the bounds of that id.
    place = lambda x: np.searchsorted(first_ids, x, side="left").astype(np.uint64) << np.uint64(32)
    at = place(known)
    same = np.isin(known, first_ids)
    within = np.searchsorted(place(first_ids) | first_heads.astype(np.uint64), at | heads, side="right")
    return np.where(same, within, at >> np.uint64(32)).astype(np.int64)


def write_warc(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               revisit_bytes: int = 1000, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``df`` as WARC files under ``root`` (a folder all executors share); returns the manifest."""
    spark = df.sparkSession
    bounded_batches(spark)
    root = _uri_of(root)
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                      F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    slim = stage(pages.select("id", "url", F.sha1("payload").alias("digest"),
                              F.octet_length("payload").cast("long").alias("n")), "warc-digests")
    size = slim.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("bytes")).first()
    groups = stage(slim.where(F.col("n") >= revisit_bytes).groupBy("digest")
                   .agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("to"), F.max_by("url", "id").alias("to_url"))
                   .where("copies > 1 and to is not null"), "warc-groups")
    links = (join_by_class(slim.where(F.col("n") >= revisit_bytes).select("id", "digest"), groups, "digest", "copies",
                           size["rows"]).select("id", "digest", "to", "to_url").dropDuplicates(["id", "digest"]))

    shards = max(1, -(-int((size["bytes"] or 0) + size["rows"] * HEADER_BYTES) // shard_bytes))
    bounds = _bounds(slim, size["rows"], shards)

    @F.arrow_udf("long")
    def shard(ids: pa.Array, digests: pa.Array) -> pa.Array:
        return pa.array(_shard_of(ids, digests, *bounds))

    none = F.lit(None).cast("string")
    both = pages.select("id", F.lit(1).alias("kind"), "url", "payload", F.sha1("payload").alias("digest"),
                        F.lit(None).cast("long").alias("to"), none.alias("to_url")).unionByName(
        links.select("id", F.lit(0).alias("kind"), none.alias("url"), F.lit(None).cast("binary").alias("payload"),
                     "digest", "to", "to_url"))
    # A shard is a task: its number is the partition, not hashed into one.
    ordered = (both.withColumn("shard", shard("id", "digest")).repartitionById(min(shards, MAX_TASKS), F.col("shard").cast("int"))
               .sortWithinPartitions("shard", "id", "kind", "digest", "url"))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    ordered.mapInArrow(_writer(root, roll_bytes, revisit_bytes), MANIFEST).write.parquet(f"{root}/manifest")
    return commit(spark, root)


def read_warc(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """Every record of the committed archives under ``root``, digests checked.

    page_id, url, record_type, refers_to, payload_bytes and payload_digest
    (bare lower-case hex), and the payload of responses when asked for. A
    revisit's length and digest are those of the payload it refers to.
    """
    root = _uri_of(root)

    def parse(batches):
        from pyarrow.fs import FileSystem
        fs, base = FileSystem.from_uri(root)
        for b in batches:
            for name, count, size, sha in zip(*(b.column(n).to_pylist() for n in ("name", "records", "bytes", "sha256"))):
                with fs.open_input_file(f"{base}/{name}") as opened:
                    content = opened.read()
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not the archive of the manifest")
                rows, held, seen = [], 0, 0
                for fields, block in records(content):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    seen += 1
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                    whole = fields["warc-type"] == "response"
                    if whole and (len(body) != length or hashlib.sha1(body).digest() != digest):
                        raise ValueError("a payload does not fit its headers")
                    page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    rows.append((None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"],
                                 None if to is None else int(to), length, digest.hex(), body if payload and whole else None))
                    held += len(body) if payload else 0
                    if len(rows) == 1000 or held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)
                if seen != count:
                    raise ValueError(f"{name} holds {seen} records, the manifest says {count}")

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    archives = manifest.select("name", "records", "bytes", "sha256")
    found = archives.repartition(max(1, min(archives.count(), MAX_TASKS)), "name").mapInArrow(
        parse, "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
               "payload_digest string, payload binary")
    return found if payload else found.drop("payload")


def warc_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back, without payloads."""
    spark = df.sparkSession
    root = scratch_path(spark, "warc")
    write_warc(df, root, **options)
    return read_warc(spark, root, payload=False)
