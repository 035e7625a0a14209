"""WARC archives, index first.

Writing: one gzip member per record; of records with equal payloads the one with
the smallest id is a response, the others revisit it.  The write leaves an index
(archive, offset, length, URL, digest, id).  Reading selects index rows,
coalesces neighbouring byte ranges of an archive into single reads and parses
the records.

Edge cases: a null html is an empty payload; payloads under `least_bytes` are
always responses; rows that repeat the smallest id of their payload are all
responses; a null id revisits unless all ids of its payload are null, and then
is a response; a null URL leaves the target header out; line breaks and blanks
of a URL are written as %XX; a very long payload is one record; an empty table
gives no archive and no row; columns other than id, URL and html are not read.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept, sided, slices
from .files import Writer, open_file, read_range

GAP = 64 << 10
SPAN = 4 << 20
ARCHIVE = 32 << 20
# Fixed value: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"


def decide(pages: DataFrame, least_bytes: int = 100, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses).

    Copies are decided on ids and digests alone; the payloads only meet the list of
    revisits, which is broadcast where it is counted to be short.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), F.sha2(F.coalesce(F.col(html), F.lit("")).cast("binary"), 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    again = kept(large.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("own_id"), F.col("digest").alias("own"), "refers_to").distinct(), "revisits")
    met = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own"))
    return rows.join(sided(again), met, "left").select("page_id", "url", "html", "digest", "refers_to")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload as stored) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:]), payload


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Writes archives of about 32 MB and returns their index, itself written to the shared folder."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, part, out = TaskContext.get(), 0, None
        for batch in slices(batches, "html"):
            index: list[tuple] = []
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is not None and out.at >= ARCHIVE:
                    out.close()
                    out, part = None, part + 1
                if out is None:
                    uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
                    out = Writer(uri)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)) + squeeze.flush()
                index.append((uri, out.write(member), len(member), url, digest, page_id, "response" if refers_to is None else "revisit", refers_to))
            columns = list(zip(*index))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = [f.split()[0] for f in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if out is not None:
            out.close()

    return kept(bounded(decided).mapInArrow(run, INDEX), "index")


def read_records(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Parses the indexed records: page_id, payload_bytes, payload_digest, record_type, refers_to, url, stored_bytes.

    Ranges of one archive that lie within `gap` bytes become one read of about `span` bytes at most.
    The digest of a response is computed anew from its payload and held against its header.
    """
    ranges = index.select("archive", "offset", "length", F.floor(F.col("offset") / span).alias("piece"))
    dealt = ranges.repartition("archive", "piece").sortWithinPartitions("archive", "offset")

    def parsed(member: bytes) -> tuple:
        fields, http, payload = parse(zlib.decompress(member, 31))
        said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        number = fields["WARC-Record-ID"][10:-1]
        refers = fields.get("WARC-Refers-To")
        if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != said:
            raise ValueError(f"the payload of page {number} does not have its digest")
        return (None if number == "None" else int(number), int(http["Content-Length"]), said, fields["WARC-Type"], int(refers[10:-1]) if refers else None, fields.get("WARC-Target-URI"), len(payload))

    def run(batches):
        import pyarrow as pa

        name, handle = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            at = 0
            while at < len(rows):
                archive, begin, length = rows[at]
                end, upto = begin + length, at + 1
                while upto < len(rows) and rows[upto][0] == archive and 0 <= rows[upto][1] - end <= gap and rows[upto][1] + rows[upto][2] - begin <= span:
                    end = rows[upto][1] + rows[upto][2]
                    upto += 1
                if archive != name:
                    name, handle = archive, open_file(archive)
                data = read_range(handle, begin, end - begin)
                found = [parsed(data[o - begin:o - begin + n]) for _, o, n in rows[at:upto]]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "stored_bytes"])
                at = upto

    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, stored_bytes bigint")
