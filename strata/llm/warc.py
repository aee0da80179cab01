"""WARC archives with a two-level capture index (operator 6).

Writing: captures are range-sorted by (reversed-host URL key, id), and a task writes one archive (a gzip member per
record) and beside it one index file: sorted capture lines in compressed blocks of BLOCK lines, then the sparse
directory of the blocks' first keys. The first level, a row per file with its key range, is as long as the number of
write partitions (``files`` at most). Reading: a key is sent to the files whose range holds it, the file's directory
is binary-searched, one block is read by range and binary-searched, and the record is read by range from the archive.

Files are written with Arrow file systems, so any folder that Spark and Arrow both know will do. A task writes under a
name of its own attempt and reports it; a lost task's rerun reports another name, and only reported files are read.

Of records with equal payloads of min_bytes or more, that with the largest id is the response and the others revisit
it; copies of that very row are responses too. Nulls: a null html is an empty payload, a null url an empty one; null
ids sort first and are never the largest. The join that finds revisits is of digests, without payloads; Spark splits
its skew.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, partitions, shared_dir, tune

BLOCK = 256
DATE = "2024-01-01T00:00:00Z"


def url_key(url):
    """Reversed-host key of a URL column: ``com,example,www)/path?query``, host and scheme case-folded."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#]*)([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^[^@]*@|:\d*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captures(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, key, kind, sha1, url, payload, refers_to): a row of kind 1 per page, and a slim one of kind 0 per revisit.

    The slim rows say which pages revisit what. They travel to the writer under the key of their page, so payloads are
    shuffled once and never joined.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url, F.lit("")).alias("url"), url_key(F.col(url)).alias("key"), F.coalesce(html, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    slim = rows.where(F.length("payload") >= min_bytes).select("id", "key", "sha1")
    again = slim.groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = slim.join(again, "sha1").where(~F.col("id").eqNullSafe(F.col("first"))).distinct()
    none = F.lit(None)
    return rows.select("id", "key", F.lit(1).alias("kind"), "sha1", "url", "payload", none.cast("long").alias("refers_to")).union(
        revisits.select("id", "key", F.lit(0), "sha1", none.cast("string"), none.cast("binary"), F.col("first"))
    )


def record(page: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head of its payload but not the payload."""
    name = lambda i, d: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {d}')}>"
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page, digest)), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", "" if page is None else str(page))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record, its payload (None in a revisit) and the payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or f"sha1:{base32_sha1(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": int(fields["Page-ID"]) if fields["Page-ID"] else None, "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": fields["WARC-Type"], "refers_to": int(fields["Refers-To-Page-ID"]) if revisit else None}


def _order(key: str, page: int | None) -> tuple:
    return (key.encode("utf-8", "surrogatepass"), page is not None, page or 0)


def _rows(batches, names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def _judged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, url, key, payload, record type, refers to) of the pages; slim rows come before the pages of their key."""
    at, told = None, {}
    for page, key, kind, sha1, url, payload, refers in rows:
        if (key, page) != at:
            at, told = (key, page), {}
        if kind == 0:
            told[sha1] = refers
        else:
            yield page, url, key, payload, "revisit" if sha1 in told else "response", told.get(sha1)


FILES = "file int, archive string, idx string, low string, low_id long, high string, high_id long, n long, directory long, size long"


def write(rows: DataFrame, folder: str, files: int, block: int = BLOCK) -> DataFrame:
    """Write captures to archives and index files; the first level of the index, a row per file."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        rows_ = _judged(_rows(batches, ["id", "key", "kind", "sha1", "url", "payload", "refers_to"]))
        head = next(rows_, None)
        if head is None:
            return
        task = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        names = [f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}{x}" for x in (".warc.gz", ".idx")]
        directory, lines, at, index_at, n, low, high = [], [], 0, 0, 0, None, None
        with store.open_output_stream(f"{path}/{names[0]}", compression=None) as archive, store.open_output_stream(f"{path}/{names[1]}", compression=None) as index:

            def flush() -> None:
                nonlocal index_at
                packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
                directory.append([*lines[0][:2], index_at, len(packed)])
                index.write(packed)
                index_at += len(packed)
                lines.clear()

            for page, url, key, payload, kind, refers in itertools.chain([head], rows_):
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = squeeze.compress(record(page, url, payload, kind, refers)) + squeeze.flush()
                archive.write(packed)
                lines.append([key, page, at, len(packed)])
                at, n, low, high = at + len(packed), n + 1, low or (key, page), (key, page)
                if len(lines) == block:
                    flush()
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode())
            index.write(packed)
        cols = [task.partitionId(), *names, *low, *high, n, index_at, len(packed)]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in FILES.split(", ")])

    order = ["key", F.col("id").asc_nulls_first()]
    return materialize(rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "kind", "sha1").mapInArrow(run, FILES))


FOUND = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def lookup(keys: DataFrame, level: DataFrame, folder: str, files: int, payloads: bool = False) -> DataFrame:
    """Every capture of the keys (key, id); level is the first level of the index, ``files`` rows at most."""
    first = sorted(level.collect(), key=lambda r: _order(r["low"], r["low_id"]))
    lows, highs = [_order(r["low"], r["low_id"]) for r in first], [_order(r["high"], r["high_id"]) for r in first]

    def route(batches):
        for b in batches:
            at, keys_, ids = [], [], []
            for key, page in _rows([b], ["key", "id"]):
                k = _order(key, page)
                i = bisect.bisect_left(highs, k)
                while i < len(lows) and lows[i] <= k:
                    at.append(i)
                    keys_.append(key)
                    ids.append(page)
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys_, pa.string()), pa.array(ids, pa.int64())], ["at", "key", "id"])

    def read(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        out: list[dict] = []
        for i, own in itertools.groupby(_rows(batches, ["at", "key", "id"]), key=lambda r: r[0]):
            with store.open_input_file(f"{path}/{first[i]['archive']}") as archive, store.open_input_file(f"{path}/{first[i]['idx']}") as index:
                directory = json.loads(zlib.decompress(index.read_at(first[i]["size"], first[i]["directory"])))
                starts, held, lines = [_order(*x[:2]) for x in directory], None, []
                for _, key, page in own:
                    k = _order(key, page)
                    d = max(0, bisect.bisect_left(starts, k) - 1)
                    while d < len(starts) and starts[d] <= k:
                        if held != d:
                            raw = zlib.decompress(index.read_at(directory[d][3], directory[d][2]))
                            held, lines = d, [json.loads(x) for x in raw.split(b"\n")]
                        for x in lines[bisect.bisect_left(lines, k, key=lambda x: _order(*x[:2])) :]:
                            if _order(*x[:2]) != k:
                                break
                            found = parse(zlib.decompress(archive.read_at(x[3], x[2]), 31))
                            out.append(found if payloads else found | {"payload": None})
                        d += 1
                    if len(out) >= (50 if payloads else 2000):
                        yield pa.RecordBatch.from_pylist(out, FOUND)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, FOUND)

    sent = keys.select("key", "id").distinct().mapInArrow(route, "at int, key string, id long")
    return sent.repartition(files, "at").sortWithinPartitions("at", "key", F.col("id").asc_nulls_first()).mapInArrow(read, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write all pages, then find and read every one back through the index."""
    spark = pages.sparkSession
    tune(spark)
    folder, files = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", partitions(spark)
    level = write(captures(pages, id_col, url, html, min_bytes), folder, files)
    keys = pages.select(F.col(id_col).cast("long").alias("id"), url_key(F.col(url)).alias("key"))
    return lookup(keys, level, folder, files).drop("payload")
