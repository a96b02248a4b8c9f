"""WARC archives: writing with revisit records, and a splittable reader.

Writing: each task writes gzip archives (one member a record) into the shared folder under names of its own attempt, and
returns a manifest row; only files in the manifest count, so a retried or lost task leaves at most an ignored file.
Of records with equal payloads of at least `min_bytes`, the smallest id is the response and the others revisit it; the
decision is one map-side combined aggregate by payload digest and a lookup with hot digests broadcast.

Reading: archives are cut into byte ranges regardless of records. The task of a range searches it for the gzip magic, accepts a
candidate only if it inflates to a WARC header with type and length, owns the records that start inside its range, and reads past
its end to finish the last one. A record's start lies in exactly one range, so every record is read once.

Both go through pyarrow.fs, so the shared folder may be any store that pyarrow opens.

Defined results: null html is an empty payload; a null url is written as an empty target; a null id stays null (such a record
is always a response, and none refers to it); repeated ids are records of their own, and all those with the smallest id of their
payload are responses; payloads of any length are read in steps; an empty table gives an empty manifest and an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, shared_dir, stash, table

MAGIC = b"\x1f\x8b\x08"
ID_URN = "urn:x-row:"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary, path string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row_id, url, payload: bytes, refers_to, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member holding a response record, or a revisit of `refers_to` (headers only)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_URN}{'' if row_id is None else row_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(data: bytes) -> dict | None:
    """Header fields (lower case) and block of an inflated record, or None."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    fields["block"] = rest[: int(fields["content-length"])]
    return fields if len(fields["block"]) == int(fields["content-length"]) else None


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int = 1 << 30) -> DataFrame:
    """Manifest (path, size, records) of the archives written."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"), F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_n"))
    rows = rows.withColumn("_row", F.concat_ws(":", F.col("_id").cast("string"), F.xxhash64("_url").cast("string")))
    groups = stash(rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_size")), "warc-groups")
    total = groups.agg(F.sum("_size")).first()[0] or 0
    ruled = attach(rows, groups, ["_digest"], "_size", total, "_row")
    revisits = (F.col("_n") >= min_bytes) & (F.col("_id") != F.col("_first"))
    ruled = ruled.select("_id", "_url", "_payload", F.when(revisits, F.col("_first")).alias("_refers"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, n = None, None, 0, 0
        done = []
        for x in batches:
            for row_id, url, html, refers in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(path, compression=None), 0, 0
                member = record_bytes(row_id, url, html, refers)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "size", "records"])

    return stash(ruled.mapInArrow(write, "path string, size long, records long"), "warc-manifest")


def records_in(read_at, size: int, start: int, end: int, step: int = 1 << 20):
    """(offset, length, fields) of the records whose gzip member starts in [start, end). read_at(offset, n) -> bytes."""
    base, buf = start, bytearray(read_at(start, min(step, size - start)))  # grows in place
    at = start
    while at < end:
        hit = buf.find(MAGIC, at - base)
        if hit < 0:
            keep = max(at, base + len(buf) - 2)
            more = read_at(base + len(buf), step)
            if not more:
                return
            buf, base, at = buf[keep - base :] + more, keep, keep
            continue
        at = base + hit
        if at >= end:
            return
        if hit > 4 * step:
            buf, base = buf[hit:], at
            hit = 0
        z, data, ok, fed = zlib.decompressobj(31), [], True, hit
        try:
            while not z.eof:
                if fed >= len(buf):
                    more = read_at(base + len(buf), step)
                    if not more:
                        ok = False
                        break
                    buf += more
                chunk = buf[fed : fed + (4096 if not data else step)]
                data.append(z.decompress(chunk))
                fed += len(chunk)
                if len(data) == 1 and not data[0].startswith(b"WARC/1.") and len(data[0]) >= 7:
                    ok = False
                    break
        except zlib.error:
            ok = False
        fields = parse_record(b"".join(data)) if ok else None
        if fields is None:
            at += 1  # magic bytes inside other data
            continue
        length = fed - len(z.unused_data) - hit
        yield at, length, fields
        at += length


def read_warc(spark: SparkSession, manifest: DataFrame, folder_uri: str | None = None, split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives in `manifest` (path, size), by byte ranges of `split_bytes`."""
    uri = folder_uri or shared_dir(spark)
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    ranges = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for x in batches:
            for path, size, start in zip(*[c.to_pylist() for c in x.columns], strict=True):
                out, held = [], 0
                with store.open_input_file(path) as f:
                    for offset, length, fields in records_in(lambda at, n, f=f: f.read_at(max(0, n), at), size, start, min(size, start + split_bytes)):
                        http, _, payload = fields["block"].partition(b"\r\n\r\n")
                        n = len(payload)
                        if fields["warc-type"] == "revisit":
                            n = next((int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")), None)
                            payload = None
                        elif fields.get("warc-payload-digest") != f"sha1:{digest_of(payload)}":
                            raise ValueError(f"payload digest differs at {path}:{offset}")
                        strip = lambda k, fields=fields: fields[k].strip("<>").removeprefix(ID_URN) if k in fields else None
                        out.append((strip("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), strip("warc-refers-to"), n, payload if with_payload else None, path, offset, length))
                        held += n if with_payload and payload else 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
                            out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return ranges.repartition(max(1, min(int(total), 20000))).mapInArrow(read, RECORD)


def op2_warc(spark, sf_dir):
    manifest = write_warc(table(spark, sf_dir, "pages"), min_bytes=0)
    got = read_warc(spark, manifest, with_payload=False)
    as_id = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return got.select(as_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
