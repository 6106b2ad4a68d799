"""Keyword-stuffed and link-list pages, by a class n-gram model of prose.

Every document becomes a string with one character per token: function words by their kind, other
words by their shape and by whether they have just been used, Han characters likewise, and the
signs, numbers, links and tags between them. A trigram model of these classes is counted on the
prose of the whole corpus (lines that read as sentences); its size is bounded by the number of
classes. The perplexity of each stretch of a document under the model is compared with that of
prose: keyword lists, links and tags surprise it, and loops of the same few keywords leave the
range of prose too. A document that consists mainly of abnormal stretches is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkivist.plans.session import cut_lineage, table

# Frequent function words of English and German by kind, and Han characters of that use.
_WORDS = {
    "d": "the a an this that these those my your his her its our their some any no every each der die das den dem des ein eine einen einem einer eines mein meine meiner dein deine sein seine ihr ihre unser unsere kein keine dieser diese dieses jeder jede",
    "n": "i you he she it we they me him us them myself who whom which what nobody everybody someone somebody everyone something nothing ich du er sie es wir mich mir dich dir ihm uns euch man niemand wer was alle beide beiden",
    "p": "of in on at by with without from to into onto about over under after before during between through near since until against for past across behind along up down out off im in an auf aus bei mit nach von vom zu zum zur über unter vor hinter neben zwischen durch für gegen ohne um seit bis trotz wegen beim am",
    "v": "is are was were be been being am has have had do does did will would can could shall should may might must not never let n't bin bist ist sind war waren wird wurde wurden werden hat hatte haben hatten kann konnte können nicht nie noch",
    "c": "and or but so because although though if when while as than then even only just too also again once still yet anyway und oder aber denn weil obwohl dass als wenn wie dann auch nur schon sehr so da doch bevor während nachdem",
}
_GERMAN_FROM = {"d": "der", "n": "ich", "p": "im", "v": "bin", "c": "und"}  # where the German words begin
_KIND = {}
for _k, _ws in _WORDS.items():
    _en, _de = _ws.split(f" {_GERMAN_FROM[_k]} ")
    _KIND |= {w: _k.upper() for w in f"{_GERMAN_FROM[_k]} {_de}".split()} | {w: _k for w in _en.split()}
_HAN_USED = frozenset("的了着过在是我你他她它们和与或也都就还不没很被把给对从到向于里上下这那有个一之后前时会能要想得地说去来又再才可以为因所但而且么吗呢吧啊谁什让替")

_TOKEN = re.compile(
    r"(?P<n>\n)|(?P<u>(?:https?://|www\.)[^\s<>\"'）)\]]+)|(?P<m><[^<>\n]{1,200}>)|(?P<h>[#＃][^\W\d_][\w-]*)|(?P<k>[A-Za-z]+-\d{2,}\b)|(?P<j>[一-鿿]+)|(?P<w>[^\W\d_一-鿿]+(?:['’][^\W\d_]+)?)|(?P<d>\d+(?:[.,:]\d+)*%?)"
    r"|(?P<e>[.!?。！？…])|(?P<c>[,，、；;：:])|(?P<q>[\"“”‘’'「」『』()（）])|(?P<b>[\[\]])|(?P<s>[^\w\s])"
)
_HEADING = re.compile(r"#{1,6} \S")
_INDENTED = re.compile(r"(?: {4}|\t)")
_SPECIAL = re.compile(r"^(?:#{1,6} |```| {4}|\t)", re.M)
# A statement, an assignment, a call, or a line of brackets only.
_CODE_LINE = re.compile(
    r"\s*(?:(?:def|class|return|import|from|for|while|if|elif|else|try|with|function|var|let|const|public|private|static|int|void|print)\b.*[\[({:;=]"
    r"|[\w.\[\]'\"]+\s*[-+*/|]?=\s*\S|[\w.]+\(.*\)\s*[;:{]?\s*(?:(?:#|//).*)?$|[})\]]+[;,]?\s*$|[^|,，、#]*[;{]\s*$)"
)
_RECENT = 10  # content words or characters within which a use counts as a repetition
STRETCH = 48  # tokens of a stretch that is judged at once
LEAST = 12  # shorter lines are judged together with the next
_SIGN = {"n": "\n", "u": "U", "m": "M", "h": "H", "k": "K", "d": "9", "e": ".", "c": ",", "q": "q", "b": "[", "s": "s"}


_ORDER = ("n", "u", "m", "h", "k", "j", "w", "d", "e", "c", "q", "b", "s")  # groups of _TOKEN by number


def judged_lines(text: str) -> str:
    """The text without lines that are neither prose nor lists.

    Those are statements of code, in a fence or indented, and headings with at least as much text
    under them as they have themselves. Keywords and links do not escape by being indented, fenced
    or written as headings.
    """
    if not _SPECIAL.search(text):
        return text
    out: list[str] = []
    fenced, head, under = False, None, 0

    def close() -> None:
        nonlocal head
        if head is not None and under >= len(out[head]):
            out[head] = ""
        head = None

    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
            continue
        if not fenced and _HEADING.match(line):
            close()
            head, under = len(out), 0
            out.append(line.lstrip("# "))
            continue
        if (fenced or _INDENTED.match(line)) and "://" not in line and _CODE_LINE.match(line):
            under += len(line)
            continue
        under += len(line.strip())
        out.append(line)
    close()
    return "\n".join(out)


def classes_of(text: str) -> str:
    """One character per token of the lines that are judged.

    D N P V C and d n p v c: function words of German and English; w W X: other words by case,
    R: one of the last few again. z: function characters, f g i: content in Han by its length, J:
    mostly characters of the last few. 9 U M H K: numbers, links, markup, tags, codes; the rest
    are signs.
    """
    out: list[str] = []
    add = out.append
    last_word: dict[str, int] = {}
    last_char: dict[str, int] = {}
    n_words = n_chars = 0
    for m in _TOKEN.finditer(judged_lines(text)):
        group = m.lastindex
        if group == 7:
            t = m[0]
            low = t.lower()
            f = _KIND.get(low)
            if f:
                add(f)
            else:
                n_words += 1
                again = n_words - last_word.get(low, -_RECENT) <= _RECENT
                last_word[low] = n_words
                add("R" if again else "w" if t[0].islower() else "X" if len(t) > 1 and t.isupper() else "W")
        elif group == 6:
            before, size, repeated = "", 0, 0
            for c in m[0] + "的":
                if c not in _HAN_USED:
                    size += 1
                    n_chars += 1
                    repeated += n_chars - size - last_char.get(c, -99) < _RECENT
                    last_char[c] = n_chars
                    continue
                if size:
                    add("J" if 2 * repeated > size else "f" if size < 3 else "g" if size < 7 else "i")
                    before, size, repeated = "", 0, 0
                if before != "z":
                    add("z")
                    before = "z"
            if m[0][-1] not in _HAN_USED:
                out.pop()  # the mark that ended the run
        else:
            add(_SIGN[_ORDER[group - 1]])
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def stretches(classes: str) -> list[str]:
    """The stretches of a class string that are judged one by one."""
    out, held = [], ""
    for line in classes.split("\n"):
        if held and len(line) >= LEAST:
            out.append(held)
            held = ""
        held = f"{held}\n{line}" if held else line
        if len(held) >= LEAST:
            n = max(1, round(len(held) / STRETCH))
            step = -(-len(held) // n)
            out += [held[i : i + step] for i in range(0, len(held), step)]
            held = ""
    return out + [held] if held else out


_FUNCTION, _LISTLIKE = b"dnpvcDNPVCz", b"RJUHMKs[X"


def is_prose(line: str) -> bool:
    """A line that reads as sentences: function words among others, an end, few list-like tokens."""
    n = len(line)
    if n < 8 or line[-1] not in ".q" and "." not in line[-3:]:
        return False
    b = line.encode("ascii")
    return 6 * (n - len(b.translate(None, _FUNCTION))) >= n and 5 * (n - len(b.translate(None, _LISTLIKE))) <= n


def prose_lines(classes: list[str]) -> list[str]:
    return [line for c in classes for line in c.split("\n") if is_prose(line)]


_CODE = np.zeros(128, dtype=np.int64)
for _i, _c in enumerate("\nDNPVCdnpvcwWXRzfgiJ9UMHK.,q[s"):
    _CODE[ord(_c)] = _i
_SIZE = 32  # classes, rounded up to a power of two
# Tokens count by about as much text as they stand for.
_WEIGHT = np.ones(_SIZE)
for _c, _w in (("U", 8.0), ("M", 6.0), ("H", 3.0), ("K", 2.0), ("g", 1.0)):
    _WEIGHT[_CODE[ord(_c)]] = _w
#: A document with less weight than this has nothing to judge.
LEAST_WEIGHT = 16
#: Stretches whose perplexity (in bits) lies further from the mean of prose than so many standard deviations are abnormal.
DEVIATIONS = 4.5


def _joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the pieces, each after two line ends; where each begins, and its length."""
    codes = _CODE[np.frombuffer(("\n\n" + "\n\n".join(pieces)).encode("ascii"), dtype=np.uint8)]
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = np.cumsum(size + 2) - size
    return codes, begin, size


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """The trigram that ends at each place from the third on."""
    return (codes[:-2] * _SIZE + codes[1:-1]) * _SIZE + codes[2:]


def _sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values)))
    return run[begin + size] - run[begin]


class ProseModel:
    """Interpolated trigram model of the classes; ``bits`` holds the surprise of each trigram."""

    def __init__(self, counts: dict[int, int], smoothing: float = 8.0):
        tri = np.zeros(_SIZE**3)
        for k, n in counts.items():
            tri[k] = n
        tri = tri.reshape(_SIZE, _SIZE, _SIZE)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * _SIZE)
        p2 = (bi + smoothing * p1) / (bi.sum(axis=1, keepdims=True) + smoothing)
        p3 = (tri + smoothing * p2) / (tri.sum(axis=2, keepdims=True) + smoothing)
        self.bits = -np.log2(p3).reshape(-1)

    def perplexities(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per token of each piece, and its weight."""
        if not pieces:
            return np.empty(0), np.empty(0)
        codes, begin, size = _joined(pieces)
        bits = _sums(self.bits[_trigrams(codes)], begin - 2, size) / np.maximum(size, 1)
        return bits, _sums(_WEIGHT[codes], begin, size)

    def abnormal_shares(self, classes: list[str], low: float, high: float) -> list[float]:
        """For each document the share, by weight, of the stretches outside [low, high]; 0 where there is too little text."""
        pieces = [stretches(c) for c in classes]
        bits, weight = self.perplexities([p for ps in pieces for p in ps])
        odd = weight * ((bits < low) | (bits > high))
        size = np.array([len(ps) for ps in pieces], dtype=np.int64)
        begin = np.cumsum(size) - size
        total, odd_total = _sums(weight, begin, size), _sums(odd, begin, size)
        return np.where(total >= LEAST_WEIGHT, odd_total / np.maximum(total, 1), 0.0).tolist()


def class_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, classes); null texts give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([classes_of(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "classes"])

    picked = docs.select("doc_id", "text").where("text IS NOT NULL")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, classes string")


def fit_prose_model(classes: DataFrame) -> ProseModel:
    """The model of all prose lines; what reaches the driver is bounded by the number of class trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, dtype=np.int64)
        for b in batches:
            if lines := prose_lines(b.column(0).to_pylist()):
                codes, begin, size = _joined([line + "\n" for line in lines])
                inside = np.zeros(len(codes) + 1, dtype=np.int64)
                inside[begin] += 1
                inside[begin + size] -= 1
                tri = _trigrams(codes)[np.cumsum(inside)[2:-1] > 0]
                counts += np.bincount(tri, minlength=_SIZE**3)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["trigram", "n"])

    rows = classes.select("classes").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    return ProseModel({r["trigram"]: r["n"] for r in rows})


def prose_range(classes: DataFrame, model: ProseModel, deviations: float = DEVIATIONS) -> tuple[float, float]:
    """Bits between which the stretches of prose lie, from their mean and deviation over the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, 0.0, 0.0
        for b in batches:
            x, _ = model.perplexities([p for line in prose_lines(b.column(0).to_pylist()) for p in stretches(line)])
            n, total, squares = n + len(x), total + float(x.sum()), squares + float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([squares])], names=["n", "total", "squares"])

    n, total, squares = classes.select("classes").mapInArrow(run, "n long, total double, squares double").agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    if not n:
        return 0.0, float("inf")  # no prose to compare with: nothing is abnormal
    mean = total / n
    spread = max(squares / n - mean * mean, 0.0) ** 0.5
    return round(mean - deviations * spread, 3), round(mean + deviations * spread, 3)  # sums of doubles vary in their last digits


def find_spam(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, abnormal_share) of the documents more than ``share`` of which is abnormal.

    docs: doc_id, text; other columns are not read. Null, empty and very short texts are never
    flagged; repeated rows come out once; an empty table gives no rows. Three maps over the class
    strings, which are cut off the texts once; no shuffle of documents.
    """
    classes = cut_lineage(class_strings(docs))
    model = fit_prose_model(classes)
    low, high = prose_range(classes, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = model.abnormal_shares(b.column(1).to_pylist(), low, high)
            keep = [i for i, x in enumerate(shares) if x > share]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([round(shares[i], 6) for i in keep], pa.float64())], names=["doc_id", "abnormal_share"])

    return classes.mapInArrow(run, f"doc_id {classes.schema['doc_id'].dataType.simpleString()}, abnormal_share double").distinct()


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: doc_id of the pages that consist mainly of keywords, links or tags."""
    return find_spam(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id").distinct()
