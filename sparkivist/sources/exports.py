"""Readers of chat exports, line chats, Markdown corpora and message logs.

Files are read whole and parsed in an Arrow map, one file a row; the kind is told by structure and
an unknown structure is reported as a problem row, never guessed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkivist.functions.chunkers import chunk_heading
from sparkivist.operators.sessions import epoch_seconds

Entry = tuple[str, str | None, str | None, str]  # text, speaker, timestamp as written, kind

ENTRY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "kind")] + [T.StructField("entry_no", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("text", "speaker", "timestamp", "problem")]
)
MESSAGE_SCHEMA = "id string, ts string, role string, text string"

_HEAD = re.compile(r"^\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2}\s+\d{1,2}:\d{2}(?::\d{2})?)\s*(.*)$")
_SAID = re.compile(r"^([^：]*)：(.*)$|^([^:]*):(.*)$")  # the full-width colon goes first


def _text_of(content: object) -> str:
    if isinstance(content, str):
        return content
    if isinstance(content, dict):
        return "\n".join(p for p in content.get("parts", []) if isinstance(p, str))
    if isinstance(content, list):
        return "\n".join(b.get("text", "") for b in content if isinstance(b, dict) and b.get("type", "text") == "text")
    return ""


def branch_entries(conv: dict) -> list[Entry]:
    """Messages from the root to the current node; abandoned branches and system nodes are left out.

    Without a current node all messages count, by time of creation. A cycle ends the walk.
    """
    nodes, at, path, seen = conv.get("mapping") or {}, conv.get("current_node"), [], set()
    if at in nodes:
        while at in nodes and at not in seen:
            seen.add(at)
            path.append(nodes[at])
            at = nodes[at].get("parent")
        path.reverse()
    else:
        path = sorted((n for n in nodes.values() if n.get("message")), key=lambda n: n["message"].get("create_time") or 0)
    out: list[Entry] = []
    for n in path:
        m = n.get("message") or {}
        role, text = (m.get("author") or {}).get("role"), _text_of(m.get("content")).strip()
        if role in ("user", "assistant") and text:
            t = m.get("create_time")
            out.append((text, role, None if t is None else str(t), "mapping"))
    return out


def sender_entries(conv: dict) -> list[Entry]:
    out: list[Entry] = []
    for m in conv.get("chat_messages") or []:
        text = (m.get("text") or _text_of(m.get("content"))).strip()
        if text:
            out.append((text, {"human": "user"}.get(m.get("sender"), m.get("sender")), m.get("created_at"), "messages"))
    return out


def line_chat_entries(text: str) -> list[Entry]:
    """Blocks under ``date time speaker`` lines, the speaker optional, or lines of the form ``speaker：text`` with either colon."""
    out: list[Entry] = []
    head: tuple[str, str] | None = None
    held: list[str] = []

    def close() -> None:
        body = "\n".join(held).strip()
        if head and body:
            out.append((body, head[1].strip() or None, head[0], "line_chat"))
        held.clear()

    for line in text.splitlines():
        if m := _HEAD.match(line):
            close()
            head = (m[1], m[2])
        elif head:
            held.append(line)
        elif m := _SAID.match(line):
            speaker, said = (x.strip() for x in m.groups() if x is not None)
            if speaker and said:
                out.append((said, speaker, None, "line_chat"))
    close()
    return out


_MARK = re.compile(r"<!--\s*写于\s*([0-9T:.+\-]+)\s*-->")
_OWN_HEAD = re.compile(r"(?m)^#{1,6}\s*(20\d{2})-(\d{1,2})-(\d{1,2})\s*记\s*$")
_NAME_DATE = re.compile(r"(20\d{2})[-._年]?(\d{1,2})[-._月]?(\d{1,2})")
_FULL_DATE = re.compile(r"(20\d{2})[-._年](\d{1,2})[-._月](\d{1,2})")
_YEAR_FIRST = re.compile(r"(20\d{2})/(\d{1,2})/(\d{1,2})")
_YEAR_LAST = re.compile(r"(\d{1,2})/(\d{1,2})/(20\d{2})")
_SHORT_DATE = re.compile(r"(?<![\d.])(\d{1,2})\s*[.月]\s*(\d{1,2})(?![\d.])")
TITLE_PREFIX = 16


def _iso(year: int | str, month: int | str, day: int | str) -> str | None:
    try:
        return date(int(year), int(month), int(day)).isoformat()
    except ValueError:
        return None


def _head_lines(text: str) -> list[str]:
    return [line for line in text.splitlines() if line.strip()][:3]


def date_order_evidence(text: str) -> tuple[int, int]:
    """How many of the first lines prove month before day, and day before month."""
    mdy = dmy = 0
    for line in _head_lines(text):
        if not _YEAR_FIRST.search(line) and (m := _YEAR_LAST.search(line)):
            mdy += int(m[2]) > 12
            dmy += int(m[1]) > 12 >= int(m[2])
    return mdy, dmy


def date_order(mdy: int, dmy: int) -> str | None:
    """The order that the evidence proves; none if there is no evidence or if it contradicts itself."""
    return None if bool(mdy) == bool(dmy) else "mdy" if mdy else "dmy"


def _slash_date(line: str, order: str | None) -> str | None:
    if m := _YEAR_FIRST.search(line):
        return _iso(*m.groups())
    if not (m := _YEAR_LAST.search(line)):
        return None
    a, b = int(m[1]), int(m[2])
    known = "mdy" if b > 12 else "dmy" if a > 12 else order
    return _iso(m[3], a, b) if known == "mdy" else _iso(m[3], b, a) if known == "dmy" else None


def chunk_date(name: str, text: str, year: int | None = None, order: str | None = None) -> tuple[str, str] | None:
    """(day, stamp) of a chunk: a record's own mark or heading, the file name, the first lines, short dates in headings.

    The stamp is the day, but for a mark it is the mark's instant. ``year`` completes short dates.
    """
    if m := _MARK.search(text):
        try:
            at = datetime.fromisoformat(m[1])
        except ValueError:
            at = None
        if at and at.tzinfo:
            return at.date().isoformat(), m[1]
    for m in filter(None, (_OWN_HEAD.search(text), _NAME_DATE.search(name))):
        if day := _iso(*m.groups()):
            return day, day
    for line in _head_lines(text):
        m = _FULL_DATE.search(line)
        near = m and (line.lstrip().startswith("#") or len(re.sub(r"[\s*_>#`\-]", "", line[: m.start()])) <= TITLE_PREFIX)
        if day := (near and _iso(*m.groups())) or _slash_date(line, order):
            return day, day
    for line in text.splitlines() if year else ():
        if line.lstrip().startswith("#"):
            for m in _SHORT_DATE.finditer(line):
                if day := _iso(year, *m.groups()):
                    return day, day
    return None


def dated_chunks(name: str, text: str, year: int | None, order: str | None) -> tuple[tuple[str, str] | None, list[tuple[str, tuple[str, str] | None]]]:
    """The date of the file, from its first lines, and its chunks with theirs; a chunk without one takes the file's."""
    whole = chunk_date(name, "\n".join(_head_lines(text)), year, order)
    return whole, [(c, chunk_date(name, c, year, order) or whole) for c in chunk_heading(text)]


def timeline_entries(text: str, name: str = "", year: int | None = None) -> list[Entry]:
    """Chunks of a Markdown timeline, the part before the first section included, each with its date."""
    _, chunks = dated_chunks(name, text, year, date_order(*date_order_evidence(text)))
    return [(c, None, at[1] if at else None, "timeline") for c, at in chunks]


def parse_export(name: str, raw: str, year: int | None = None) -> tuple[list[Entry], list[str]]:
    """Entries of a file and what is wrong with it, if anything; an odd item of a list leaves the others' entries."""
    if name.endswith(".json"):
        try:
            data = json.loads(raw)
        except ValueError:
            return [], ["not JSON"]
        out: list[Entry] = []
        problems: list[str] = []
        for i, c in enumerate(data if isinstance(data, list) else [data]):
            keys = c if isinstance(c, dict) else ()
            if "mapping" in keys:
                out += branch_entries(c)
            elif "chat_messages" in keys:
                out += sender_entries(c)
            elif "docs" in keys:
                out += [(d["content"].strip(), None, d.get("created_at"), "project") for d in c["docs"] if (d.get("content") or "").strip()]
            elif "conversations_memory" in keys:
                if (c["conversations_memory"] or "").strip():
                    out.append((c["conversations_memory"].strip(), None, None, "memory"))
            else:
                problems.append(f"item {i}: unknown structure" if isinstance(data, list) else "unknown structure")
        return out, problems if out or problems else ["empty"]
    if name.lower().endswith((".md", ".markdown")):
        entries = timeline_entries(raw, unquote(name), year)
    else:
        entries = line_chat_entries(raw) or (timeline_entries(raw, unquote(name), year) if re.search(r"(?m)^## ", raw) else [])
    return entries, [] if entries else ["unknown structure" if raw.strip() else "empty"]


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all .json, .md and .txt files under ``path``, and a row for each problem; a file without any entry has one at least."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"), "value", F.year("_metadata.file_modification_time").alias("year"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, raw, year in zip(*(c.to_pylist() for c in b.columns)):
                entries, problems = parse_export(name, raw, year)
                rows += [(name, e[3], i, e[0], e[1], e[2], None) for i, e in enumerate(entries)] + [(name, None, None, None, None, None, x) for x in problems]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.string()) for i, c in enumerate(cols)], names=ENTRY_SCHEMA.names)

    return files.mapInArrow(run, ENTRY_SCHEMA)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, layer, window_no, chunk_no, local_date, text): chunks of the Markdown files; a folder named index holds the summaries.

    A first pass finds the order of slash dates in the whole corpus. A chunk without a date of its own
    or of its file takes that of the first file with the same window that has one.
    """
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.year("_metadata.file_modification_time").alias("year"), F.col("value").alias("text"))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [date_order_evidence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["mdy", "dmy"])

    proof = f.select("text").mapInArrow(evidence, "mdy long, dmy long").agg(F.sum("mdy"), F.sum("dmy")).first()
    order = date_order(proof[0] or 0, proof[1] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for p, year, text in zip(*(c.to_pylist() for c in b.columns)):
                whole, chunks = dated_chunks(unquote(p.rsplit("/", 1)[-1]), text, year, order)
                day = whole[0] if whole else None
                rows += [(p, day, n, at[0] if at else None, c) for n, (c, at) in enumerate(chunks)] or [(p, day, None, None, None)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.string()) for i, c in enumerate(cols)], names=["path", "file_date", "chunk_no", "day", "text"])

    parts = F.split("path", "/")
    number = F.regexp_extract(F.element_at(parts, -1), r"window_(\d+)", 1)
    chunks = f.mapInArrow(run, "path string, file_date string, chunk_no int, day string, text string").withColumns(
        {"source": F.element_at(parts, -1), "layer": F.when(F.element_at(parts, -2) == "index", "index").otherwise("timeline"), "window_no": F.when(number != "", number.cast("long"))}
    )
    siblings = chunks.where("window_no IS NOT NULL AND file_date IS NOT NULL").groupBy("window_no").agg(F.min_by("file_date", "path").alias("borrowed"))
    return chunks.where("chunk_no IS NOT NULL").join(siblings, "window_no", "left").select("source", "layer", "window_no", "chunk_no", F.coalesce("day", "borrowed").alias("local_date"), "text")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(key, epoch, role, text) of JSON-lines logs; lines that are no JSON and messages without a role or text are left out.

    Times are seconds, milliseconds or ISO; a message without an id gets the digest of its content.
    """
    m = spark.read.schema(MESSAGE_SCHEMA).json(path, mode="DROPMALFORMED")
    iso = F.unix_micros(F.try_to_timestamp("ts")) / 1e6
    epoch = F.when(F.col("ts").rlike(r"^\d+(\.\d+)?$"), epoch_seconds(F.expr("try_cast(ts AS double)"))).otherwise(iso)
    kept = m.where("role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''")
    return kept.select(F.coalesce("id", F.substring(F.md5(F.concat_ws("|", "ts", "role", "text")), 1, 16)).alias("key"), epoch.alias("epoch"), "role", "text")


def write_windows(rows: DataFrame, path: str, window: str = "window_no") -> None:
    """Rows as parquet, a folder per window; each window is written by one task of its own."""
    rows.repartition(window).write.mode("overwrite").partitionBy(window).parquet(path)
