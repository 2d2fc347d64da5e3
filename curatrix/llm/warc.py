"""WARC records in ZIP-packaged archives: written by tasks, found through their indexes and read by ranges.

An archive is one ZIP file: ``archive/*.warc.gz`` with a gzip member for each record, ``indexes/index.cdxj`` with the place of
each record, and ``datapackage.json``, all stored, not deflated. So a record is a range of the file. The reader range-reads the end of
the file, the ZIP64 records where there are any, and the central directory; it takes each member's place from its local header and each record's
from the index, and deals the records out by place. Tasks read neighbouring records with one request of bounded size. Nothing is
extracted, and no archive goes through one task but for its directory and index.

Files are opened by tasks through ``pyarrow.fs``, by the URI of a folder that all executors share.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_folder, new_path, qualified
from .common import slices, small, spread, stage, table

#: Bytes from which a member and an archive are closed, and which one request reads, at most if records are shorter.
MEMBER_BYTES, ARCHIVE_BYTES, REQUEST_BYTES = 8 << 20, 128 << 20, 8 << 20
#: Archived bytes that a reading task gets.
TASK_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES, INDEXES = "archive/", "indexes/"
_BLOCK = 1 << 20
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


# ZIP files.


class StoredZip:
    """A ZIP file of stored members on a stream that is only appended to. zip64: 64-bit fields even where they are not needed."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64, self.at, self.entries = stream, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """The place of the member's data."""
        raw, crc, size, header = name.encode(), binascii.crc32(data), len(data), self.at
        wide = self.zip64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _FULL32 if wide else size
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self.entries.append((raw, crc, size, header))
        at = self.at
        self._put(data)
        return at

    def close(self) -> int:
        """Write the directory; the file's size."""
        start = self.at
        for raw, crc, size, header in self.entries:
            wide = self.zip64 or size >= _FULL32 or header >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header) if wide else b""
            sizes = (_FULL32,) * 3 if wide else (size, size, header)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, *sizes[:2], len(raw), len(extra), 0, 0, 0, 0, sizes[2]) + raw + extra)
        size, count = self.at - start, len(self.entries)
        if wide := self.zip64 or count >= _FULL16 or start >= _FULL32 or size >= _FULL32:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, *((_FULL16, _FULL16, _FULL32, _FULL32) if wide else (count, count, size, start)), 0))
        return self.at


def directory(file, size: int) -> Iterator[dict]:
    """The members of a ZIP file by range reads: name, method, flags, packed size and the place of the local header.

    Bytes in front of the archive, a comment behind it and ZIP64 records are allowed for; ValueError where there is no directory.
    """
    reach = min(size, 22 + _FULL16)
    tail = file.read_at(reach, size - reach)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and not (at + 22 <= len(tail) and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") <= len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = size - reach + at
    locator = file.read_at(20, end - 20) if end >= 20 else b""
    if locator[:4] == b"PK\6\7":
        stated = struct.unpack("<Q", locator[8:16])[0]
        # Bytes in front shift all places; then the record stands right before its locator.
        for place in (stated, end - 76):
            record = file.read_at(56, place) if 0 <= place <= end - 56 else b""
            if record[:4] == b"PK\6\6":
                count, length, start = struct.unpack("<QQQ", record[32:56])
                end = place
                break
        else:
            raise ValueError("no ZIP64 end of directory")
    shift = end - length - start
    if shift < 0:
        raise ValueError("the ZIP directory does not fit into the file")
    at, held, done = start + shift, b"", 0
    limit = at + length

    def need(n: int) -> None:
        nonlocal held, at
        while len(held) < n:
            if not (more := file.read_at(min(_BLOCK, limit - at), at) if at < limit else b""):
                raise ValueError("the ZIP directory is cut off")
            held, at = held + more, at + len(more)

    while done < count:
        need(46)
        sign, _, _, flags, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, header = struct.unpack("<4s6H3I5H2I", held[:46])
        if sign != b"PK\1\2":
            raise ValueError("no entry where the ZIP directory should have one")
        need(46 + n_name + n_extra + n_comment)
        raw, extra = held[46 : 46 + n_name], held[46 + n_name : 46 + n_name + n_extra]
        held = held[46 + n_name + n_extra + n_comment :]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain, packed, header = (next(wide, x) if x == _FULL32 else x for x in (plain, packed, header))
            extra = extra[4 + n :]
        yield {"name": raw.decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "flags": flags, "crc": crc, "size": packed, "plain": plain, "header": header + shift}
        done += 1


def data_place(file, header: int) -> int:
    """Where a member's data begin; names and extra fields of the local header may differ from the directory's."""
    local = file.read_at(30, header)
    if local[:4] != b"PK\3\4":
        raise ValueError("no local header")
    return header + 30 + sum(struct.unpack("<HH", local[26:30]))


def _blocks(file, at: int, size: int) -> Iterator[bytes]:
    while size:
        if not (data := file.read_at(min(_BLOCK, size), at)):
            raise ValueError("the file is cut off")
        at, size = at + len(data), size - len(data)
        yield data


def _inflated(blocks: Iterator[bytes], bits: int) -> Iterator[bytes]:
    """What deflated data (bits -15) or gzip members, one after another (31), hold."""
    unpack = zlib.decompressobj(bits)
    for data in blocks:
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(bits)
                if bits < 0:
                    return


def _lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for data in blocks:
        *whole, held = (held + data).split(b"\n")
        yield from whole
    if held:
        yield held


# Records.


def _field(text: str) -> str:
    """Header text without blanks, control characters and anything beyond ASCII; ``unquote`` gives it back."""
    return quote(text, safe="!#$&'()*+,/:;=?@[]~-._|{}^`<>\"\\")


def record_id(key: str | None, digest: str) -> str:
    """The same for the same row, whichever task writes it."""
    h = hashlib.md5(f"{'' if key is None else 'v' + key}\0{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(key: str | None, url: str | None, payload: bytes, first: tuple[str | None, str | None] | None, date: str = DATE) -> tuple[bytes, str]:
    """A record's bytes and its payload's digest; first: the id and URL that a revisit refers to, None for a response."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _field(url))] if url else []
    fields += [("Source-Row-ID", _field(key))] if key is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{digest}")]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], digest))]
        fields += [("WARC-Refers-To-Target-URI", _field(first[1]))] if first[1] else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields).encode() + b"\r\n" + block + b"\r\n\r\n", digest


def _headers(raw: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n")
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, sep, v in (x.partition(b":") for x in lines[1:]) if sep}


_FIELDS = (("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("source_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to_uri", pa.string()), ("error", pa.string()))
RECORD_SHAPE = "archive string, at long, record_type string, record_id string, target_uri string, date string, source_id string, payload binary, payload_bytes long, payload_digest string, refers_to_record string, refers_to_uri string, error string"


def parse_record(raw: bytes) -> dict:
    """A record's columns. A revisit's payload is null, its length and digest are those its headers state; a response's are its payload's own."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return {"error": "no WARC record"}
    fields = _headers(head)
    kind, length = fields.get("warc-type"), fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return {"record_type": kind, "record_id": fields.get("warc-record-id"), "error": "cut off"}
    block = rest[: int(length)]
    uri, source, refers = fields.get("warc-target-uri"), fields.get("source-row-id"), fields.get("warc-refers-to-target-uri")
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": uri and unquote(uri), "date": fields.get("warc-date"), "source_id": source and unquote(source) if source else source, "refers_to_record": fields.get("warc-refers-to"), "refers_to_uri": refers and unquote(refers)}
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, http = block, {}
    if fields.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(first)
    if kind == "revisit":
        size = http.get("content-length", "")
        return out | {"payload_bytes": int(size) if size.isdigit() else None, "payload_digest": stated}
    digest = payload_digest(payload)
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "error": "digest differs" if stated and re.fullmatch("[A-Z2-7]{32}", stated) and stated != digest else None}


def _whole(raw: bytes) -> bytes:
    """A record's bytes, unpacked where they are a gzip member."""
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


def walk(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, record) of a member that no index lists, from its beginning; gzip members or plain records."""
    held, at = b"", 0

    def more() -> bool:
        nonlocal held
        data = next(blocks, None)
        held += data or b""
        return data is not None

    while held or more():
        if len(held) < 2 and more():
            continue
        if held[:2] == b"\x1f\x8b":
            unpack, parts, used = zlib.decompressobj(31), [], 0
            while not unpack.eof:
                parts.append(unpack.decompress(held[used:]))
                used = len(held)
                if not unpack.eof and not more():
                    break
            size = len(held) - len(unpack.unused_data)
            yield at, b"".join(parts)
        else:
            while (end := held.find(b"\r\n\r\n")) < 0 and more():
                pass
            length = _headers(held[: max(end, 0)]).get("content-length", "")
            size = end + 8 + int(length) if end >= 0 and length.isdigit() else len(held) + 1
            while len(held) < size and more():
                pass
            yield at, held[:size]
        held, at = held[size:], at + size


# Jobs.


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def decided(docs: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, payload, and for revisits ``first`` (id, url): of equal payloads of ``least_bytes`` or more, rows of the least id are responses."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    groups = rows.filter(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"))
    groups = stage(groups.filter("n > 1").select(F.col("key").alias("of_key"), "first.id", "first.url").withColumnsRenamed({"id": "first_id", "url": "first_url"}), "payloads")
    told = rows.join(small(groups), (F.col("key") == F.col("of_key")) & (F.octet_length("html") >= least_bytes), "left")
    revisit = F.col("of_key").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return told.select(F.col("id").cast("string").alias("id"), "url", F.col("html").cast("binary").alias("payload"), revisit.alias("revisit"), F.col("first_id").cast("string").alias("first_id"), "first_url")


def _surt(url: str) -> str:
    """The index's sorting key: host names from the right, then the path."""
    parts = urlsplit(_field(url))
    return f"{','.join(reversed(parts.netloc.lower().split('.')))}){parts.path}{'?' + parts.query if parts.query else ''}"


def _writing(folder: str, date: str, member_bytes: int, archive_bytes: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        # A name of its own for each attempt: what a lost one leaves is in no manifest.
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        system, base = _open(folder)
        made: list[tuple[str, int, int]] = []
        stream = packed = None
        member: list[bytes] = []
        places: list[tuple[str, str]] = []
        held = n_members = 0

        def close_member() -> None:
            nonlocal member, held, n_members
            if member:
                packed.add(f"{ARCHIVES}part-{n_members:05d}.warc.gz", b"".join(member))
                member, held, n_members = [], 0, n_members + 1

        def close_archive() -> None:
            nonlocal stream, packed, places, n_members
            if packed is not None:
                close_member()
                places.sort()
                packed.add(f"{INDEXES}index.cdxj", "".join(f"{k} {v}\n" for k, v in places).encode())
                packed.add("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"name": r[0].decode(), "path": r[0].decode(), "bytes": r[2]} for r in packed.entries]}).encode())
                size = packed.close()
                stream.close()
                made.append((f"{folder}/{name}-{len(made):04d}.zip", size, len(places)))
                stream, packed, places, n_members = None, None, [], 0

        for batch in slices(batches):
            for key, url, payload, revisit, first_id, first_url in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "revisit", "first_id", "first_url"))):
                if packed is None:
                    stream = system.open_output_stream(f"{base}/{name}-{len(made):04d}.zip")
                    packed = StoredZip(stream, zip64)
                raw, digest = make_record(key, url, payload, (first_id, first_url) if revisit else None, date)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(raw) + pack.flush()
                about = {"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if revisit else "text/html", "status": "200", "offset": str(held), "length": str(len(data)), "filename": f"part-{n_members:05d}.warc.gz"}
                places.append((f"{_surt(url or '')} {re.sub('[^0-9]', '', date)}", json.dumps(about)))
                member.append(data)
                held += len(data)
                if held >= member_bytes:
                    close_member()
                    if packed.at >= archive_bytes:
                        close_archive()
        close_archive()
        columns = list(zip(*made)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "records"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = DATE, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record for each row below ``folder``; the manifest (archive, bytes, records) names the archives that count.

    A null html is an empty payload. Of rows with equal payloads of ``least_bytes`` bytes or more those of the least id are responses (a null
    id comes last; repeated rows of that id are all responses), others are revisits; shorter payloads are all responses. A null id or URL leaves its
    header out. An empty table writes no archive. A row's html is held by one task. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    rows = decided(docs, id_col, url_col, html_col, least_bytes)
    return stage(rows.mapInArrow(_writing(folder, date, member_bytes, archive_bytes, zip64), "archive string, bytes long, records long"), "manifest")


def archives_in(spark: SparkSession, folder: str, pattern: str = "*.{zip,wacz}") -> DataFrame:
    """(archive, bytes) of the ZIP files below a folder, from the listing alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("archive"), F.col("length").alias("bytes"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(archive, at, length, whole, error): each record's range by the index; a member that no index lists as a whole."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["archive", "at", "length", "whole", "error"])

    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            rows: list[tuple] = []
            try:
                system, path = _open(uri)
                with system.open_input_file(path) as file:
                    data, indexes, listed = {}, [], set()
                    for x in directory(file, file.size()):
                        if x["name"].startswith(ARCHIVES) and re.search(r"\.warc(\.gz)?$", x["name"]):
                            if x["method"] or x["flags"] & 1:
                                rows.append((uri, x["header"], x["size"], True, f"{x['name']} is not stored"))
                            else:
                                data[x["name"].removeprefix(ARCHIVES)] = (data_place(file, x["header"]), x["size"])
                        elif x["name"].startswith(INDEXES) and re.search(r"\.cdxj?(\.gz)?$", x["name"]) and x["method"] in (0, 8) and not x["flags"] & 1:
                            indexes.append(x)
                    for x in indexes:
                        blocks = _blocks(file, data_place(file, x["header"]), x["size"])
                        blocks = _inflated(blocks, -15) if x["method"] == 8 else blocks
                        for line in _lines(_inflated(blocks, 31) if x["name"].endswith(".gz") else blocks):
                            _, sep, about = line.partition(b" {")
                            try:
                                about = json.loads(b"{" + about) if sep else {}
                                name, at, length = about.get("filename"), int(about.get("offset", -1)), int(about.get("length", -1))
                            except (ValueError, TypeError, AttributeError):
                                continue
                            if name in data and 0 <= at and 0 < length and at + length <= data[name][1]:
                                listed.add(name)
                                rows.append((uri, data[name][0] + at, length, False, None))
                                if len(rows) >= 10_000:
                                    yield out(rows)
                                    rows = []
                    rows += [(uri, at, size, True, None) for name, (at, size) in data.items() if name not in listed]
            except (OSError, ValueError, zlib.error, struct.error) as e:
                rows.append((uri, None, None, True, str(e)))
            yield out(rows)


def _reading(request_bytes: int):
    """Records of ranges that come by archive and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("at", pa.int64()), *_FIELDS]))

        def parsed(uri: str, at: int, raw: bytes) -> dict:
            try:
                found = parse_record(_whole(raw))
            except zlib.error as e:
                found = {"error": str(e)}
            return {"archive": uri, "at": at} | found

        for batch in slices(batches, 4096):
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length", "whole", "error"))))
            k = 0
            while k < len(ranges):
                uri, at, length, whole, error = ranges[k]
                if error:
                    yield out([{"archive": uri, "at": at, "error": error}])
                    k += 1
                    continue
                if uri != now:
                    if file is not None:
                        file.close()
                    system, path = _open(uri)
                    now, file = uri, system.open_input_file(path)
                if whole:
                    rows, size = [], 0
                    for place, raw in walk(_blocks(file, at, length)):
                        rows.append(parsed(uri, at + place, raw))
                        size += len(raw)
                        if size >= request_bytes:
                            yield out(rows)
                            rows, size = [], 0
                    yield out(rows)
                    k += 1
                    continue
                # Records that follow each other are read with one request.
                end, z = at + length, k + 1
                while z < len(ranges) and ranges[z][0] == uri and ranges[z][1] == end and not ranges[z][3] and end + ranges[z][2] - at <= request_bytes:
                    end, z = end + ranges[z][2], z + 1
                data = memoryview(file.read_at(end - at, at))
                rows, size = [], 0
                for _, a, n, _, _ in ranges[k:z]:
                    rows.append(parsed(uri, a, bytes(data[a - at : a - at + n])))
                    size += rows[-1].get("payload_bytes") or 0
                    if size >= request_bytes:  # packed bytes may unfold to many times as many
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)
                k = z
        if file is not None:
            file.close()

    return run


def read_records(archives: DataFrame, request_bytes: int = REQUEST_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of ZIP-packaged archives (columns archive, a URI that tasks can open, and bytes), by range reads; columns as RECORD_SHAPE.

    A member that an index lists is read by its entries, any other stored one from its beginning. Deflated or encrypted archive members, broken records and
    archives give a row with ``error`` and no payload. Null and repeated archives are read once or not at all. No archive gives no rows. An
    archive's directory and index are read by one task, in blocks; a record is held by one task.
    """
    spark = archives.sparkSession
    archives = archives.filter("archive IS NOT NULL").groupBy("archive").agg(F.max("bytes").alias("bytes"))
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    files = archives.select("archive").repartition(max(cores, total // ARCHIVE_BYTES + 1), "archive")
    places = files.mapInArrow(_places, "archive string, at long, length long, whole boolean, error string")
    # Rows are small and what they stand for is large: the tasks are counted by bytes of the archives.
    chunk = F.floor(F.col("at") / request_bytes)
    dealt = places.distinct().repartition(max(cores, total // task_bytes + 1), "archive", chunk).sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(_reading(request_bytes), RECORD_SHAPE)


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``refers_to``: the source id of the response that a revisit refers to; null where it isn't there or has another payload."""
    first = records.filter("record_type = 'response' AND error IS NULL").groupBy(F.col("record_id").alias("of_record")).agg(F.min("source_id").alias("refers_to"), F.min("payload_digest").alias("of_digest"))
    wanted = (F.col("record_type") == "revisit") & (F.col("refers_to_record") == F.col("of_record")) & (F.col("payload_digest") == F.col("of_digest"))
    return records.join(first, wanted, "left").drop("of_record", "of_digest")


def op11_warc(spark, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = new_path(spark, "archives")
    records = stage(read_records(write_archives(pages, folder)).drop("payload"), "records")
    drop_folder(spark, folder)
    found = resolved(records)
    return found.select(F.col("source_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, ''))) AS digest FROM pages),
r AS (SELECT p.*, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT page_id, html, first, digest, CAST(digest AS BIT) AS b FROM r)
SELECT page_id, strlen(html) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(CAST(b AS VARCHAR), 5 * k + 1, 5)::BIT::INT AS INT), 1), '' ORDER BY k) FROM (SELECT unnest(range(32)) AS k)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""
