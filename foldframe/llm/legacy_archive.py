"""Legacy web archives (ARC, versions 1 and 2) to WARC: declared lengths, synthesised identifiers, dates, types and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.work import Work, slices

#: Uncompressed bytes after which a task begins another archive; one larger record makes a larger archive.
ARCHIVE_BYTES = 32 << 20
#: Fixed values of the formats: header fields of either ARC version, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def one_token(value: str | None, otherwise: str) -> str:
    """A header field without white space or control characters."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in value) if value else otherwise


# ---------------------------------------------------------------- ARC


def arc_head(name: str, version: int, date: str) -> bytes:
    """The version block that opens an archive; its body names the version and the header fields of all that follow."""
    body = f"{version} 0 foldframe\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, name: str, offset: int) -> bytes:
    middle = "" if version == 1 else f"200 {digest(content)} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} {mime} {middle}{len(content)}\n".encode() + content


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one archive, cut by their declared lengths; the version block says which fields a header line has."""
    at, fields, version = 0, None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without an end at byte {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        if not line[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}")
        size, offset = int(line[-1]), at
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(content)} are left")
        at = end + 1 + size
        if fields is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("an archive must begin with its version block")
            head = content.decode("utf-8", "replace").splitlines()
            version, fields = int(head[0].split()[0]), head[1].split()
            continue
        if len(line) != len(fields):
            raise ValueError(f"version {version} has {len(fields)} header fields, the line at byte {offset} has {len(line)}")
        known = dict(zip(fields, line, strict=True))
        yield {"offset": offset, "version": version, "url": known["URL"], "ip": known["IP-address"], "date": known["Archive-date"], "mime": known["Content-type"], "content": content}


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """(header with its empty line, body) of an HTTP response, None of anything else."""
    if not content.startswith(b"HTTP/"):
        return None
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


# ---------------------------------------------------------------- WARC


def warc_date(date14: str) -> str:
    """Archive-date (14 digits, shorter ones padded) as a WARC date."""
    d = (date14 + "00000101000000"[len(date14) :])[:14] if date14.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(archive: str, offset: int) -> str:
    """The same identifier whenever the same record of the same archive is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}:{offset}')}"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the very last newline, which the text writer adds."""
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC header at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not have its declared length {size}")
        yield fields, block
        at = end + 8 + size


# ---------------------------------------------------------------- Spark


def write_archives(records: DataFrame, path: str, suffix: str) -> None:
    """records(archive, place, data) as gzip files, one folder ``archive=name`` each, records in order of place.

    Spark's text writer ends each value with a newline and otherwise writes its bytes as they are, so any store that Spark reaches
    will do, and a task that is lost is committed once. The fastest level of compression: archives are read again at once.
    """
    in_order = records.sortWithinPartitions("archive", "place").select("archive", F.col("data").cast("string").alias("value"))
    in_order.write.partitionBy("archive").option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def archive_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content): every archive below ``path``, gzip or plain; one row is one archive of bounded size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^archive=", "").alias("archive"), "content")


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


ARCHIVED = "archive string, place int, data binary"


def _packed(make) -> callable:
    """Batches of rows to archive records: ``make(version, name)`` gives (opening record, row -> record at an offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, place, size, head, one = TaskContext.get().partitionId(), -1, 0, ARCHIVE_BYTES, None, None
        for part in slices(batches):
            names, places, data = [], [], []
            for row in part.to_pylist():
                if size >= ARCHIVE_BYTES:
                    k, place, size = k + 1, 0, 0
                    name = f"{task:06d}-{k:05d}"
                    head, one = make(1 + (task + k) % 2, name)
                    names.append(name), places.append(0), data.append(head)
                    size += len(head) + 1
                place += 1
                got = one(row, size)
                names.append(name), places.append(place), data.append(got)
                size += len(got) + 1
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(data, pa.binary())], ["archive", "place", "data"])

    return run


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20000101000000") -> None:
    """Write pages as ARC archives, by turns of version 1 and 2; each page is an HTTP response with its id in a header.

    Nothing is shuffled: a task writes its own rows. A null html is an empty body, a null url ``unknown:``, a null id no header.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))

    def make(version: int, name: str):
        def one(row: dict, offset: int) -> bytes:
            own = "" if row["id"] is None else f"{PAGE_HEADER}: {row['id']}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}\r\n".encode()
            return arc_record(version, one_token(row["url"], "unknown:"), date, "text/html", head + row["html"], name, offset)

        return arc_head(name, version, date), one

    write_archives(rows.mapInArrow(_packed(make), ARCHIVED), path, "arc")


def read_arc(spark: SparkSession, path: str, contents: bool = True) -> DataFrame:
    """Records of ARC archives: archive, offset, version, record_id, url, ip, date, mime, http, rank, payload bytes, digests and (if
    ``contents``) the record's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, packed in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for r in parse_arc(plain(packed.as_py())):
                    http = split_http(r["content"])
                    payload = http[1] if http else r["content"]
                    own = http_field(http[0], PAGE_HEADER) if http else None
                    rows.append({"archive": archive, "offset": r["offset"], "version": r["version"], "record_id": record_id(archive, r["offset"]), "url": r["url"], "ip": r["ip"], "date": warc_date(r["date"]), "mime": r["mime"],
                                 "http": http is not None, "rank": int(own) if own else None, "payload_bytes": len(payload), "payload_key": hashlib.sha256(payload).digest(), "payload_digest": digest(payload),
                                 "content": r["content"] if contents else None})
                    size += len(r["content"])
                    if len(rows) >= 4096 or (contents and size > 8 << 20):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"archive": "string", "offset": "long", "version": "int", "record_id": "string", "url": "string", "ip": "string", "date": "string", "mime": "string", "http": "boolean", "rank": "long", "payload_bytes": "long", "payload_key": "binary", "payload_digest": "string", "content": "binary"}
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(k, arrow[v]) for k, v in kinds.items()])
    return archive_bytes(spark, path).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def convert(spark: SparkSession, arc_path: str, warc_path: str, work: Work, min_bytes: int = 0) -> None:
    """ARC archives to WARC archives.

    Of records with equal payloads (length and SHA-256) of at least ``min_bytes``, that with the largest rank (the page header; records
    without one come last, then archive and offset decide) becomes the response, the others revisit it and keep their HTTP header
    only. Shorter payloads are all responses, records that are no HTTP response become resources. The first pass reads no contents
    on. The decisions on the revisits of an archive come to its compressed bytes as one list, no longer than the archive has records,
    so records are not shuffled one by one; each archive becomes one WARC archive of its name.
    """
    index = work.keep(read_arc(spark, arc_path, contents=False).select("archive", "offset", "record_id", "url", "date", "http", "rank", "payload_bytes", "payload_key"), "index")
    order = F.struct(F.coalesce("rank", F.lit(-(2**63))).alias("r"), "archive", "offset")
    able = index.where((F.col("payload_bytes") >= min_bytes) & F.col("http"))
    keepers = able.groupBy("payload_key", "payload_bytes").agg(F.max_by(F.struct(F.col("record_id").alias("to"), F.col("url").alias("to_url"), F.col("date").alias("to_date")), order).alias("k"), F.count(F.lit(1)).alias("copies"))
    revisits = able.select("archive", "offset", "record_id", "payload_key", "payload_bytes").join(keepers.where("copies > 1"), ["payload_key", "payload_bytes"]).where("record_id <> k.to").select("archive", "offset", "k.*")
    decided = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "to", "to_url", "to_date")).alias("revisits"))
    archives = archive_bytes(spark, arc_path).join(decided.hint("shuffle_hash"), "archive", "left")

    def one(archive: str, r: dict, revisit: dict | None) -> bytes:
        content, http = r["content"], split_http(r["content"])
        block = http[0] if revisit else content
        to = revisit or {"to": None, "to_url": None, "to_date": None}
        kind = "revisit" if revisit else "response" if http else "resource"
        return warc_record([
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(archive, r['offset'])}>"), ("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"] if r["ip"] != "0.0.0.0" else None),
            ("Content-Type", "application/http; msgtype=response" if http else r["mime"]), ("WARC-Payload-Digest", f"sha1:{digest(http[1] if http else content)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", f"<{to['to']}>" if revisit else None), ("WARC-Refers-To-Target-URI", to["to_url"]), ("WARC-Refers-To-Date", to["to_date"]),
        ], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: foldframe\r\nformat: WARC File Format 1.0\r\n"
        for batch in batches:
            for archive, content, known in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("revisits").to_pylist(), strict=True):
                to = {k["offset"]: k for k in known or ()}
                data = [warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_id(archive, -1)}>"), ("WARC-Date", warc_date("")), ("Content-Type", "application/warc-fields")], info)]
                place, size = 0, 0
                for r in parse_arc(plain(content.as_py())):
                    data.append(one(archive, r, to.get(r["offset"])))
                    size += len(data[-1])
                    if size > 8 << 20:
                        yield packed(archive, place, data)
                        place, size, data = place + len(data), 0, []
                if data:
                    yield packed(archive, place, data)

    def packed(archive: str, place: int, data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([archive] * len(data)), pa.array(range(place, place + len(data)), pa.int32()), pa.array(data, pa.binary())], ["archive", "place", "data"])

    write_archives(archives.mapInArrow(run, ARCHIVED), warc_path, "warc")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC archives but warcinfo: record_type, record_id, rank, url, date, payload_digest, payload_bytes (null for
    revisits), refers_to_id. Declared lengths cut the records; block and payload digests are checked."""
    names = ["record_type", "record_id", "rank", "url", "date", "payload_digest", "payload_bytes", "refers_to_id"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("content"):
                rows = []
                for f, block in parse_warc(plain(packed.as_py())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    http = split_http(block)
                    told = f["warc-payload-digest"].removeprefix("sha1:")
                    payload = None if f["warc-type"] == "revisit" else http[1] if http else block
                    if f["warc-block-digest"] != f"sha1:{digest(block)}" or (payload is not None and told != digest(payload)):
                        raise ValueError(f"digest of {f['warc-record-id']} does not hold")
                    own = http_field(http[0], PAGE_HEADER) if http else None
                    rows.append((f["warc-type"], f["warc-record-id"].strip("<>"), int(own) if own else None, f["warc-target-uri"], f["warc-date"], told, None if payload is None else len(payload), f.get("warc-refers-to", "").strip("<>") or None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return archive_bytes(spark, path).mapInArrow(run, "record_type string, record_id string, rank long, url string, date string, payload_digest string, payload_bytes long, refers_to_id string")


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per input row. A null html is an empty payload; a page with a null id is the response only if no page with an id has its
    payload, and then the last in archive order is; repeated rows count as copies of each other. Other columns are not read.
    """
    spark = pages.sparkSession
    work = Work(spark, "archives")
    write_arc(pages, work.path("arc"))
    convert(spark, work.path("arc"), work.path("warc"), work, min_bytes)
    work.drop("arc", "index")
    back = work.keep(read_warc(spark, work.path("warc")), "back")
    full = back.where("record_type <> 'revisit'")
    first = full.select(F.col("record_id").alias("refers_to_id"), F.col("rank").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    seen = back.where("record_type = 'revisit'").join(first, "refers_to_id")
    cols = [F.col("rank").alias("page_id")]
    return full.select(*cols, "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        seen.select(*cols, F.col("full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
