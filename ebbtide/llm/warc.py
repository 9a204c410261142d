"""WARC archives: written by Spark tasks with one gzip member per record, read back sequentially and verified.

A record's block is an HTTP response: its header, whose Content-Length is that of the full payload, and the payload. Of records
with equal payloads of at least ``REVISIT_BYTES`` bytes only the one with the smallest id carries it; the others are revisits
with the header alone. Which one that is comes from counts per digest, pre-aggregated, joined back on the digest: a payload that
very many pages share is split like any skewed join, and payloads are shuffled once at most.

The reader works through an archive as a stream: bytes are inflated a piece at a time, a gzip member's end is a record's end,
Content-Length frames header and block, and both digests are checked while the pieces pass. It holds one piece, not a record,
unless payloads are asked for. Each attempt of a writing task uses file names of its own, and only the names in the written list
are read, so a lost executor leaves nothing that counts twice.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import small_batches
from ebbtide.runtime import materialize, scratch_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
PIECE = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
NO_ID = "none"


class Damaged(ValueError):
    """An archive that does not hold what its framing or digests say."""


def _id(page: str | None) -> str:
    return f"<{URN}{page or NO_ID}>"


def _page(urn: str) -> int | None:
    page = urn.removeprefix(f"<{URN}").removesuffix(">")
    return None if page == NO_ID else int(page)


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(first)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html) under ``folder``, a URI that all executors reach; returns the list (archive, records).

    Null html is an empty payload, a null url gives no target URI, a null page_id is written as such and never the first of its
    payload unless all are null. Repeated rows are records of their own: those with the smallest id are all responses. An empty
    table gives no archive. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select("page_id", "url", html.alias("_html"), F.sha2(html, 256).alias("_digest"), F.octet_length(html).alias("_bytes"))
    digests = given.where(F.col("_bytes") >= REVISIT_BYTES).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    shared = materialize(digests.where("_n > 1").drop("_n"))
    marked = given.drop("_bytes").join(shared, "_digest", "left")
    marked = marked.withColumn("_revisit", F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for row in zip(b["page_id"], b["url"], b["_html"], b["_digest"], b["_first"], b["_revisit"], strict=True):
                page, url, text, digest, first, revisit = row
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = record(page, url, text.encode(), digest, first, revisit)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [count]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [count]})

    listed = marked.select(
        F.col("page_id").cast("string"), "url", "_html", "_digest", F.col("_first").cast("string"), "_revisit").mapInPandas(run, "archive string, records long")
    return materialize(listed)


class Reader:
    """The records of one archive stream, in order."""

    def __init__(self, stream, with_payload: bool = False) -> None:
        self.stream, self.with_payload, self.rest = stream, with_payload, b""

    def _raw(self) -> bytes:
        data, self.rest = self.rest or self.stream.read(PIECE), b""
        return data

    def _member(self, inflater) -> Iterator[bytes]:
        """Inflated pieces of the member that ``inflater`` is at; what follows it goes to ``rest``."""
        data = b""
        while not inflater.eof:
            data = data or self._raw()
            if not data:
                raise Damaged("the archive ends inside a gzip member")
            piece = inflater.decompress(data, PIECE)
            data = inflater.unconsumed_tail
            if piece:
                yield piece
        self.rest = inflater.unused_data or self.rest

    def __iter__(self) -> Iterator[dict]:
        while True:
            self.rest = self._raw()
            if not self.rest:
                return
            yield self._record(self._member(zlib.decompressobj(31)))

    def _record(self, pieces: Iterator[bytes]) -> dict:
        head = b""
        while b"\r\n\r\n" not in head:
            head += self._next(pieces)
        head, _, left = head.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise Damaged("a member that does not start with a WARC version")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        missing, block, body = int(fields["content-length"]), hashlib.sha256(), hashlib.sha256()
        http, kept, n, in_body = b"", [], 0, False
        while missing:
            left = left or self._next(pieces)
            part, left = left[:missing], left[missing:]
            missing -= len(part)
            block.update(part)
            if not in_body:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                in_body = True
            body.update(part)
            n += len(part)
            if self.with_payload:
                kept.append(part)
        for piece in pieces:
            left += piece
        if left != b"\r\n\r\n" or not in_body:
            raise Damaged("Content-Length does not frame the block")
        revisit = fields["warc-type"] == "revisit"
        whole = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if fields["warc-block-digest"] != f"sha256:{block.hexdigest()}":
            raise Damaged("block digest")
        if n != (0 if revisit else whole) or not revisit and digest != body.hexdigest():
            raise Damaged("payload digest")
        uri = fields.get("warc-target-uri")
        return {
            "page_id": _page(fields["warc-record-id"]), "url": uri and uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_bytes": whole, "payload_digest": digest, "record_type": fields["warc-type"],
            "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload": b"".join(kept) if self.with_payload and not revisit else None}

    @staticmethod
    def _next(pieces: Iterator[bytes]) -> bytes:
        piece = next(pieces, None)
        if piece is None:
            raise Damaged("a record is shorter than its framing says")
        return piece


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame, with_payload: bool = False, rows: int = 64) -> DataFrame:
    """One row per record of the archives listed in column ``archive``; a damaged archive raises ``Damaged``."""
    small_batches(archives.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(found: list[dict]) -> pd.DataFrame:
            # Ids must not pass through floats where some are missing.
            kinds = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
            return pd.DataFrame({k: pd.array([r[k] for r in found], dtype=kinds.get(k, object)) for k in names})

        for b in batches:
            for uri in b["archive"]:
                store, name = fs.FileSystem.from_uri(uri)
                found = []
                with store.open_input_stream(name, compression=None) as stream:
                    for r in Reader(stream, with_payload):
                        found.append(r)
                        if len(found) >= (rows if with_payload else 4096):
                            yield frame(found)
                            found = []
                if found:
                    yield frame(found)

    # An archive is one task's work: deal the list out evenly.
    return archives.select("archive").repartition(max(1, archives.count())).mapInPandas(run, FIELDS)


def archive_folder(spark) -> str:
    """A new folder below the shared one."""
    return f"{scratch_dir(spark)}/warc/{uuid.uuid4().hex}"
