"""WARC files: writing with revisit records, and reading with boundary-chain verification.

Reading: tasks take byte ranges of the files. In its range a task finds every place where a record could begin and where such a
record would end, which is where its successor would begin; a record's magic inside a payload is such a candidate too. Candidates
whose successor lies in the same range are followed at once, so that each has one pointer out of its range. Pointer jumping from
the start of each file then finds the places where the chain enters the ranges, in a number of rounds that is the logarithm of the
ranges of a file. Only records that the chain reaches are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, small_batches, written
from .files import make_dir, new_file, opened

MAGIC = b"WARC/1.1\r\n"
#: Payloads of so many bytes at least are written once.
REVISIT_BYTES = 1000
#: A file ends after so many bytes; a task reads a range of so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
#: So much is read at once where a header block is looked for; a longer one is read on.
HEADER_BYTES = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)


def record_bytes(fields: list[tuple[str, str]], payload: bytes) -> bytes:
    head = MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8")
    return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


def one_line(value: str) -> str:
    """A header value without line ends; they and percent signs are escaped."""
    return re.sub(r"[\x00-\x1f%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def revisits(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another: of equal payloads of ``least`` bytes or more, all but that with the largest id."""
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    seen = pages.select(F.col(id_col).alias("id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= least)
    seen = written(seen.select("id", "digest"), "op2-digests")
    best = seen.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written, so that the join has plain exchanges on both sides, and Spark can split the partition of a hot digest.
    best = written(best, "op2-responses")
    return seen.join(best, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for every row and returns the list of files (path, bytes, records).

    The payload is the body in UTF-8; a null body is empty, a null url is left out, and so is a null id. Rows that repeat id and body of a
    response are responses again. An empty table writes no file. Other columns are not read. A task that is run again writes files
    of other names, and the list has those of one attempt only. Urls and bodies may have any length; line ends, control and percent signs of a url are escaped. The pages are not moved, unless those that revisit are too many to broadcast.
    """
    spark = pages.sparkSession
    small_batches(spark, 500)
    folder = folder or fresh_dir(spark, "op2-warc")
    make_dir(folder)
    again = written(revisits(pages, id_col, body_col, least), "op2-revisits")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    rows = rows.join(again.withColumnsRenamed({"id": "id_", "digest": "digest_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_")), "left").select("id", "url", "body", "digest", "refers_to", F.col("digest_").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        done: list[tuple[str, int, int]] = []
        while row is not None:
            with new_file(folder, f"pages-{no:06d}", ".warc") as (f, name):
                at = n = 0
                while row is not None and at < file_bytes:
                    id_, url, body, digest, to, revisit = row
                    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{id_}/{digest}/{n}/{name}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
                    if url is not None:
                        fields.append(("WARC-Target-URI", one_line(url)))
                    if id_ is not None:
                        fields.append(("X-Page-ID", one_line(str(id_))))
                    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(body)))]
                    if revisit:
                        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", one_line(str(to)))]
                    raw = record_bytes(fields, b"" if revisit else body)
                    f.write(raw)
                    at, n, row = at + len(raw), n + 1, next(rows, None)
            done.append((name, at, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "records"])

    return written(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "op2-files")


def read_to_blank(f, at: int, size: int) -> bytes:
    """The bytes from ``at`` up to a blank line at least, if there is one; each byte is looked through once."""
    f.seek(at)
    raw, seen = bytearray(), 0
    while at + len(raw) < size:
        more = f.read(min(max(HEADER_BYTES, len(raw)), size - at - len(raw)))
        if not more:
            break
        raw += more
        if raw.find(b"\r\n\r\n", seen) >= 0:
            break
        seen = max(0, len(raw) - 3)
    return bytes(raw)


def in_range(f, begin: int, end: int, size: int) -> list[tuple[int, int]]:
    """(place, end of its record) of every place in [begin, end) where a record could begin, payloads included. A header block ends at the first blank line after its
    beginning, however far that is; blank lines and lengths are found once for the range, so a payload full of beginnings costs no more than another."""
    f.seek(begin)
    raw = f.read(min(size, end + len(MAGIC) - 1) - begin)
    starts = [m.start() for m in re.finditer(re.escape(MAGIC), raw) if m.start() < end - begin]
    if not starts:
        return []
    raw += read_to_blank(f, begin + len(raw), size) if raw.find(b"\r\n\r\n", starts[-1]) < 0 else b""
    blanks = [m.start() for m in re.finditer(rb"\r\n(?=\r\n)", raw)]
    lengths = [(m.start(), m.end(), int(m[1])) for m in _LENGTH.finditer(raw)]
    at = [x[0] for x in lengths]
    out = []
    for start in starts:
        b, n = bisect_left(blanks, start + len(MAGIC) - 2), bisect_left(at, start + len(MAGIC) - 2)
        if b < len(blanks) and n < len(lengths) and lengths[n][1] <= blanks[b] and begin + (after := blanks[b] + 4 + lengths[n][2] + 4) <= size:
            out.append((begin + start, begin + after))
    return out


def head_of(f, at: int, size: int) -> tuple[bytes, int, int] | None:
    """(what was read, bytes of the header block, bytes of the whole record) of the record at a place, or None where none begins."""
    raw = read_to_blank(f, at, size)
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(MAGIC) or end < 0:
        return None
    found = _LENGTH.search(raw, len(MAGIC) - 2, end + 2)
    return (raw, end + 4, end + 4 + int(found[1]) + 4) if found else None


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    rows = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {range_bytes}"))).alias("no"))
    return rows.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path", "no")


def candidates(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, no, place, leaves, n): the candidates of all ranges; ``leaves`` is where the chain from there leaves its range, -1 if it breaks, and n its records in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                begin, end = r["no"] * range_bytes, min(r["bytes"], (r["no"] + 1) * range_bytes)
                with opened(r["path"]) as f:
                    found = in_range(f, begin, end, r["bytes"])
                out: dict[int, tuple[int, int]] = {}
                for place, after in reversed(found):
                    # A successor inside the range that is no candidate leads nowhere.
                    leaves, n = (after, 0) if after >= end else out.get(after, (-1, 0))
                    out[place] = leaves, n + 1
                at = list(out)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(at), pa.string()), *(pa.array(x, pa.int64()) for x in ([r["no"]] * len(at), at, [x for x, _ in out.values()], [n for _, n in out.values()]))], names=["path", "no", "place", "leaves", "n"])

    return ranges(files, range_bytes).mapInArrow(run, "path string, no bigint, place bigint, leaves bigint, n bigint")


def entries(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, place, n): where the chain from each file's start enters the file's ranges, by pointer jumping, and how many of its records begin in that range."""
    found = written(candidates(files, range_bytes), "op2-candidates")
    start = files.where("bytes > 0").select("path", F.lit(0).cast("bigint").alias("place"))
    # Only a place that some candidate leads to, or a file's start, can be an entry.
    wanted = found.where("leaves >= 0").select("path", F.col("leaves").alias("place")).union(start).distinct()
    jump = written(found.join(wanted, ["path", "place"], "left_semi").select("path", "place", F.col("leaves").alias("to")), "op2-jumps")
    reached = written(jump.join(start, ["path", "place"], "left_semi").select("path", "place"), "op2-reached")
    most = files.agg(F.max("bytes")).head()[0] or 0
    for _ in range((max(1, -(-most // range_bytes)) - 1).bit_length()):
        ahead = reached.join(jump, ["path", "place"]).select("path", F.col("to").alias("place")).join(jump.select("path", "place"), ["path", "place"], "left_semi")
        reached = written(reached.union(ahead).distinct(), "op2-reached")
        twice = jump.select("path", "place", "to").join(jump.select("path", F.col("place").alias("to"), F.col("to").alias("next")), ["path", "to"])
        jump = written(twice.select("path", "place", F.col("next").alias("to")).union(jump.join(twice.select("path", "place"), ["path", "place"], "left_anti").select("path", "place", F.lit(-1).cast("bigint").alias("to"))), "op2-jumps")
    return written(reached.join(found.select("path", "place", "n"), ["path", "place"]), "op2-entries")


def check_whole(files: DataFrame, into: DataFrame) -> None:
    """Raises if from any file other than so many records are reached as its list says (null: not known)."""
    got = into.groupBy("path").agg(F.sum("n").alias("n"))
    off = files.where("records IS NOT NULL").join(got, "path", "left").where("coalesce(n, 0) <> records").select("path", "records", F.coalesce("n", F.lit(0)).alias("n")).head()
    if off:
        raise ValueError(f"{off.path} was written with {off.records} records, {off.n} are reached")



def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES, bodies: bool = False, whole: bool = False) -> DataFrame:
    """A row for every record that the chains reach: path, place, page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, body.

    A response's length and digest are those of the payload read, and must be those in its header; a revisit's are from its header.
    A file whose start is no record gives no row; what follows a broken record is not reached; with ``whole``, either raises if the list of files says how many records a file has.
    Header blocks and payloads may have any length. A missing id or url is null. An empty list gives an empty result.
    """
    into = entries(files, range_bytes)
    if whole:
        check_whole(files, into)
    into = into.select("path", "place").join(files.select("path", "bytes"), "path").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path", "place")
    kinds = [("path", pa.string()), ("place", pa.int64()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("body", pa.binary())] * bodies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, end, rows = r["place"], min(r["bytes"], (r["place"] // range_bytes + 1) * range_bytes), []
                with opened(r["path"]) as f:
                    while at < end:
                        if not (found := head_of(f, at, r["bytes"])):
                            break
                        head, first, whole = found
                        f.seek(at + first)
                        body = head[first : whole - 4] if whole <= len(head) else f.read(whole - 4 - first)
                        if at + whole > r["bytes"] or len(body) != whole - 4 - first:
                            break
                        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[: first - 4].decode("utf-8", "replace").split("\r\n")[1:])}
                        kind, digest = field.get("warc-type"), field.get("warc-payload-digest", "").removeprefix("sha1:")
                        size = int(field["x-payload-length"]) if field.get("x-payload-length", "").isdigit() else len(body)
                        if kind == "response":
                            own = hashlib.sha1(body, usedforsecurity=False).hexdigest()
                            if (digest and own != digest) or len(body) != size:
                                raise ValueError(f"the payload at {at} of {r['path']} is not what its header says")
                            digest = own
                        rows.append((r["path"], at, field.get("x-page-id"), field.get("warc-target-uri"), kind, field.get("x-refers-to-page-id"), size, digest, *[body] * bodies))
                        at += whole
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    spec = "path string, place bigint, page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", body binary" * bodies
    return into.select("path", "place", "bytes").mapInArrow(run, spec)


def op2_query(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_warc(write_warc(pages), whole=True).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
