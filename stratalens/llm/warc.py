"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A record is a row (headers MAP<STRING,STRING>, block STRING). Each response
yields a metadata record, a JSON envelope of the response's WARC and HTTP
headers with title and links, and a conversion record with its plain text.
Both refer to the response by WARC-Refers-To and carry its digests along with
their own.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.0"
_CRLF = "\r\n"
# No pattern runs past the next '<' for a '>' that isn't there, so pages of unclosed tags take linear time too.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"""</?([a-zA-Z][^\s/<>]*)(?:"[^"]*"|'[^']*'|[^'"<>])*+>|<[!?][^<>]*>""")
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.I), re.compile(r"</title\s*>", re.I)
_TARGET = re.compile(r"""\s(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose text runs on within a line.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())


def plain_text(page: str) -> str:
    """Text of an HTML page: hidden elements out, a line per block element, entities resolved."""
    shown = _HIDDEN.sub(" ", page)
    lined = _TAG.sub(lambda m: "" if (m[1] or "").lower() in _INLINE else "\n", shown)
    lines = (" ".join(line.split()) for line in html.unescape(lined).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    """The first title's text."""
    begin = _TITLE.search(page)
    end = begin and _TITLE_END.search(page, begin.end())
    return " ".join(html.unescape(page[begin.end() : end.start()]).split()) if end else None


def links(page: str) -> list[dict[str, str]]:
    """Targets of the links and images that aren't hidden."""
    out = []
    for tag in _TAG.finditer(_HIDDEN.sub(" ", page)):
        name = (tag[1] or "").lower()
        target = _TARGET.search(tag[0]) if name in ("a", "link", "img") and tag[0][1] != "/" else None
        if target:
            out.append({"path": name, "url": html.unescape(target[1] or target[2] or target[3] or "")})
    return out


def digest(data: bytes) -> str:
    return "sha1:" + hashlib.sha1(data).hexdigest()


def http_parts(block: str) -> tuple[str, dict[str, str], str]:
    """Status line, headers and payload of an HTTP response; a block without a header end is all payload."""
    head, found, payload = block.partition(_CRLF + _CRLF)
    if not found or not head.startswith("HTTP/"):
        return "", {}, block
    status, *lines = head.split(_CRLF)
    pairs = (line.partition(":") for line in lines)
    return status, {k.strip(): v.strip() for k, _, v in pairs}, payload


def _derived(kind: str, source: dict[str, str], block: str, content_type: str) -> dict[str, str]:
    refers, data = source.get("WARC-Record-ID", ""), block.encode()
    out = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {refers}')}>",
        "WARC-Refers-To": refers,
        "WARC-Target-URI": source.get("WARC-Target-URI", ""),
        "WARC-Date": source.get("WARC-Date", ""),
        "WARC-Block-Digest": digest(data),
        "Content-Type": content_type,
        "Content-Length": str(len(data)),
    }
    if source.get("WARC-Payload-Digest"):
        out["WARC-Refers-To-Payload-Digest"] = source["WARC-Payload-Digest"]
    return out


def derive(headers: dict[str, str], block: str) -> list[tuple[dict[str, str], str]]:
    """The metadata and the conversion record of one response record."""
    status, fields, payload = http_parts(block)
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "Actual-Content-Digest": digest(payload.encode()),
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": fields,
                    "HTML-Metadata": {"Title": title_of(payload), "Links": links(payload)},
                },
            },
        }
    }
    meta = json.dumps(envelope, ensure_ascii=False, sort_keys=True)
    text = plain_text(payload)
    return [(_derived("metadata", headers, meta, "application/json"), meta), (_derived("conversion", headers, text, "text/plain"), text)]


def _deriver(carry: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                index, headers, blocks = [], [], []
                for i, row in enumerate(some.select(["headers", "block"]).to_pylist()):
                    own = {k: v or "" for k, v in row["headers"] or ()}
                    if own.get("WARC-Type", "response") == "response":
                        for h, b in derive(own, row["block"] or ""):
                            index.append(i)
                            headers.append(list(h.items()))
                            blocks.append(b)
                kept = some.select(carry).take(pa.array(index, pa.int32()))
                columns = [*kept.columns, pa.array(headers, schema.field("headers").type), pa.array(blocks, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records, metadata and conversion, for each response row (headers, block); other columns are carried along.

    Rows whose WARC-Type is another than response give nothing; a missing type
    counts as response. Null headers are no headers, a null block is empty, and
    either still gives both records. Record ids follow from the type and the
    referred id, so equal rows give equal records. Long blocks are converted
    whole; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = [c for c in responses.columns if c not in ("headers", "block")]
    plain = responses.select(*carry, F.col("headers").cast("map<string,string>"), F.col("block").cast("string"))
    return plain.mapInArrow(_deriver(carry, to_arrow_schema(plain.schema)), plain.schema)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, headers, block: a response record for each row of `pages(page_id, url, html)`.

    The record id follows from page_id, url and html. Null url or html is empty.
    """
    body, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    name = F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), url, body).cast("binary"))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), F.lit(">"))
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    block = F.concat(F.lit(_CRLF.join(lines) + _CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF + _CRLF), body)
    with_block = pages.select("page_id", urn.alias("urn"), url.alias("url"), F.sha1(body.cast("binary")).alias("payload"), block.alias("block"))
    fields = {
        "WARC-Type": F.lit("response"), "WARC-Record-ID": F.col("urn"), "WARC-Target-URI": F.col("url"), "WARC-Date": F.lit(date),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "payload"), "WARC-Block-Digest": F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary"))),
        "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.octet_length("block").cast("string"),
    }
    return with_block.select("page_id", F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]).alias("headers"), "block")


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Write rows (headers, block) as WARC files, one per partition."""
    head = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), _CRLF)
    text = F.concat(F.lit(VERSION + _CRLF), head, F.lit(_CRLF + _CRLF), F.coalesce("block", F.lit("")))
    writer = records.select(text.alias("value")).write.option("lineSep", _CRLF * 2)
    (writer.option("compression", compression) if compression else writer).text(path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from what stands between separators; a block shorter than its Content-Length goes on with what follows."""
    separator = _CRLF * 2 + VERSION + _CRLF
    headers: list[tuple[str, str]] | None = None
    parts: list[str] = []
    missing = 0

    def ended() -> pa.RecordBatch:
        data = separator.join(parts).encode()
        length = next((v for k, v in headers if k == "Content-Length" and v.isdigit()), None)
        # A file's last record is followed by blank lines that no separator took.
        block = data.removesuffix(b"\r\n\r\n") if length is None else data[: int(length)]
        kind = pa.map_(pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([list(dict(headers).items())], kind), pa.array([block.decode(errors="replace")])], ["headers", "block"])

    for batch in batches:
        for piece in batch.column(0).to_pylist():
            if headers is not None and missing > 0 and not piece.startswith(VERSION + _CRLF):
                parts.append(piece)
                missing -= len(separator) + len(piece.encode())
                continue
            if headers is not None:
                yield ended()
            head, found, rest = piece.removeprefix(VERSION + _CRLF).partition(_CRLF * 2)
            lines = [line.partition(": ") for line in head.split(_CRLF)]
            whole = bool(found) and all(mark for _, mark, _ in lines)
            headers = [(k, v) for k, _, v in lines] if whole else []
            parts = [rest if whole else piece]
            length = dict(headers).get("Content-Length", "")
            missing = int(length) - len(parts[0].encode()) if length.isdigit() else 0
    if headers is not None:
        yield ended()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers and block of the records of WARC files with UTF-8 blocks; large files are read in splits.

    Blank lines and a version line tell records apart, and the Content-Length
    tells a block that holds such lines itself. Only where such a block runs
    from one split of an uncompressed file into the next does its rest come as
    a row without headers. A record without a length ends at the separator.
    """
    raw = spark.read.option("lineSep", _CRLF * 2 + VERSION + _CRLF).text(path)
    return raw.mapInArrow(_records, "headers map<string,string>, block string")
