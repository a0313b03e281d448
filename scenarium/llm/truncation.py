"""Text cut off by field limits: hashed logistic regression trained on artificially cut values.

Values become *units*: a caption; of a model's output, each answer that holds JSON, each caption inside whole JSON, and each answer of
prose. The pass that makes them also makes the features of a unit's end, and the keys under which statistics over all
units are joined to it: how often its last word closes a value, with or without a full stop, and occurs at all; how values that
begin alike end; how many copies it has; the length at which its source's open-ended values pile up. Texts themselves are
never shuffled.

The model is trained on a bounded sample, taken at the scan by a threshold on a hash: as they are stored, values count as intact; cut at a
random place, with or without something put after the cut, they are positives. The tasks cut and make the features; the
driver gets numbers only. Further fits leave out stored values that a model of others took for cut. Every unit is then
scored, and the model alone decides: that JSON is open by its brackets is a feature among others.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scenarium.storage import Scratch, together

#: Units of each kind in the training sample: those whose hash is below the threshold that gives so many, more or less.
SAMPLE = 12_000
#: Features a task remembers before it starts anew.
WORDS_HELD = 200_000
#: Values that begin alike from which their habit is known, and other values of the same text from which there are some copies.
LEAST_HABIT, LEAST_COPIES = 8, 3
#: Weights of the model.
WEIGHTS = 1 << 16
#: Examples a feature needs to get a weight.
LEAST_SUPPORT = 20
#: Parts of the sample: each is cleaned by a model of the others.
FOLDS = 2
CLEANINGS = 4
#: Weight of an artificial cut beside a stored value: cut values are the fewer.
CUT_WEIGHT = 0.3
CUT_AT = 0.5
#: Times as many values of one length as of those around it that show a limit.
PILE = 5
UNIT = (
    "field string, record_id bigint, source string, kind string, text string, open boolean, length bigint, most bigint, same bigint, "
    "local array<int>, closed boolean, letters string, word bigint, head bigint"
)
_TYPES = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
    pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.int64(), pa.int64(),
]
_LOCAL = 9
#: The word statistics: a word stands before a full stop, closes a value without one, occurs at all; values that begin with a
#: head (their first two words) end with a full stop, or without one.
COUNTS = ["stop", "bare", "seen", "ended", "unended"]

_HEADER = re.compile(r"^===[^\n]*===[ \t]*$", re.M)
_JSON = re.compile(r'\{(?=\s*(?:"|\}|\Z))')
_FENCE = re.compile(r"^\s*```[A-Za-z]*[ \t]*$|```[A-Za-z]*\s*\Z", re.M)
_CAPTION = re.compile(r'"(caption|acoustic_caption)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([^u])", re.S)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_BEGIN = re.compile(r"[\W_]*([^\W_]+(?:['’-][^\W_]+)*)(?:[\W_]+([^\W_]+(?:['’-][^\W_]+)*))?")
_LETTER = re.compile(r"[^\W_]")
#: Fixed values for the JVM's regular expressions: a word with the full stop that may follow it; scripts without spaces.
_TOKEN = r"""[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*(?:["')\]}»”’）」』]*(?:[.!?](?=[\s"')\]}»”’]|$)|[。！？]))?"""
_STOPS = ".!?。！？\"')]}»”’）」』"
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_TERMINAL = ".!?。！？"
_CLOSERS = "\"')]}»”’）」』"


def unescaped(s: str) -> str:
    """The text of a JSON string's inside; what is broken in it stays as it is."""
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else plain.get(m[2], m[2]), s)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def json_end(s: str, start: int) -> int | None:
    """The place after the object that begins at ``start``; None if it isn't brought to its end."""
    depth, i, n = 0, start, len(s)
    special = re.compile(r'["{}\[\]]')
    closing = re.compile(r'["\\]')
    while True:
        m = special.search(s, i)
        if not m:
            return None
        i, ch = m.end(), m.group()
        if ch == '"':
            while True:
                m = closing.search(s, i)
                if not m or m.end() >= n and m.group() == "\\":
                    return None
                i = m.end() + (m.group() == "\\")
                if m.group() == '"':
                    break
        elif ch in "{[":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return i


def answers(raw: str) -> list[str]:
    """The answers of an output: what stands between stage headers; blank ones left out."""
    return [a for a in _HEADER.split(raw) if a.strip()]


def units_of_answer(a: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, open) of an answer."""
    found, at, state = False, 0, False
    said: list[str] = []
    while m := _JSON.search(a, at):
        found = True
        end = json_end(a, m.start())
        if end is None:
            state = True
            break
        said += [unescaped(c[2]) for c in _CAPTION.finditer(a, m.start(), end)]
        at = end
    if not found:
        yield "prose", _FENCE.sub("", a), False
        return
    yield "json", a, state
    for text in said:
        if text.strip():
            yield "said", text, False


def _closing(text: str) -> tuple[str, str, str]:
    """(body, mark, word): a text without what follows its last word or sign; a mark of what was there; its last word."""
    s = text.rstrip()
    mark = "space" if len(s) < len(text) else ""
    if s.endswith("```"):
        s, mark = s[:-3].rstrip(), mark + "fence"
    for dots in ("...", "…"):
        if s.endswith(dots):
            s, mark = s[: -len(dots)].rstrip(), mark + "dots"
            break
    words = _WORD.findall(s[s.rfind(" ", 0, -1) + 1 :]) or _WORD.findall(s[-80:])
    word = words[-1].lower() if words else ""
    if word and _WIDE.search(word[-1]):
        word = word[-3:]
    return s, mark, word


def _key(text: str) -> int:
    """A 64-bit hash, the same as the engine's ``xxhash64``."""
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)
    return n - (1 << 64) if n >> 63 else n


def _same(kind: str, text: str) -> int | None:
    """The key of a unit's text, by which its copies are counted; answers with JSON have none."""
    return None if kind == "json" else _key(text.strip())


def _bit(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}|{name}".encode("utf-8", "replace")) % WEIGHTS


def _head(s: str) -> str:
    m = _BEGIN.match(s[:80].lower())
    return "" if m is None else m[1] if m[2] is None else f"{m[1]} {m[2]}"


_CLAUSE = re.compile(r"[.!?。！？]\s*")
#: Features that were made before, by what they are made from; started anew when there are too many.
_made: dict[tuple, list[int]] = {}
_named: dict[tuple, int] = {}


def _bit_of(kind: str, what: str, word: str, closed: bool) -> int:
    key = kind, what, word, closed
    got = _named.get(key)
    if got is None:
        if len(_named) > WORDS_HELD:
            _named.clear()
        got = _named[key] = _bit(kind, f"{what}:{word}:{closed}")
    return got


def local(kind: str, text: str, is_open: bool) -> tuple[list[int], bool, str, int | None, int | None]:
    """What a unit's own end gives: (features, whether it ends with a full stop, case of its first letter, key of its last word,
    key of its head). JSON has no words."""
    s, mark, word = _closing(text)
    last = s[-1:]
    sign = "stop" if last and last in _TERMINAL else "closer" if last and last in _CLOSERS else "letter" if last.isalpha() else "digit" if last.isdigit() else "none" if not last else last
    inner = s.rstrip(_CLOSERS)
    closed = inner[-1:] in _TERMINAL if inner else False
    if kind == "json":
        key = kind, is_open, mark, sign
        got = _made.get(key)
        if got is None:
            names = ["bias", f"mark:{mark}", f"open:{is_open}", f"json:{is_open}", f"jsign:{sign}", f"jopen:{is_open}:{mark}"]
            got = _made[key] = [_bit(kind, n) for n in names]
        return got, closed, "", None, None
    m = _LETTER.search(s)
    first = m.group() if m else ""
    case = "upper" if first.isupper() else "lower" if first.islower() else "other"
    clause = _CLAUSE.split(s[-160:].rstrip(_CLOSERS + _TERMINAL))[-1]
    item = clause.rsplit(",", 1)[-1].split()
    begin = s.split(None, 5)
    spaced = inner[-1:].isspace() or (text[-1:].isspace() and not closed)
    key = kind, is_open, mark, sign, closed, case, "," in clause, min(len(item), 5), spaced, len(begin) < 5
    got = _made.get(key)
    if got is None:
        if len(_made) > WORDS_HELD:
            _made.clear()
        names = ["bias", f"mark:{mark}", f"open:{is_open}", f"end:{closed}:{sign}", f"end:{closed}:{mark}", f"case:{case}:{closed}"]
        names += [f"list:{case}:{key[6]}:{key[7]}:{closed}", f"spaced:{spaced}:{closed}", f"single:{key[9]}:{closed}"]
        got = _made[key] = [_bit(kind, n) for n in names]
    own = [_bit_of(kind, "last", word, closed), _bit_of(kind, "head", " ".join(s[:40].split()[:2]).lower(), closed)]
    own += [_bit_of(kind, f"before{k}", w.lower(), closed) for k, w in enumerate(reversed(item[-4:-1]))]
    head = _head(s)
    return got + own, closed, case, _key(word) if word else None, _key(head) if head else None


def copies(others: int) -> str:
    """How many other values are the same text: a cut value has hardly any."""
    return "few" if others < LEAST_COPIES else "some" if others < 10 else "many"


def _gap(length: int, most: int) -> str:
    gap = most - length
    return "none" if most <= 0 else str(gap) if -2 <= gap <= 3 else "over" if gap < 0 else str(gap.bit_length() - 1)


def _level(x: int) -> str:
    return "0" if x <= 0 else str(min(x, 64).bit_length() - 1)


def _share(x: int, seen: int) -> str:
    return "none" if x < 2 else str(int(np.log2(max(1e-5, x / max(seen, x)))))


def _habit(ended: int, unended: int) -> str:
    """How many of the values that begin alike end with a full stop."""
    n = ended + unended
    share = ended / n if n else 0
    return "rare" if n < LEAST_HABIT else "never" if share < 0.1 else "seldom" if share < 0.5 else "often" if share < 0.8 else "always"


class Statistics:
    """Features of the statistics that were joined to a unit, remembered by the few values they are made from."""

    def __init__(self) -> None:
        self.words: dict[tuple, list[int]] = {}
        self.others: dict[tuple, list[int]] = {}

    def features(self, kind: str, closed: bool, case: str, length: int, most: int, others: int, word: tuple[int, int, int] | None, head: tuple[int, int]) -> list[int]:
        """word: stop, bare, seen of the last word (None: there is none); head: ended, unended."""
        key = kind, closed, case, _gap(length, most), copies(others), _habit(*head)
        got = self.others.get(key)
        if got is None:
            gap, copied, habit = key[3:]
            names = [f"gap:{gap}"]
            if kind != "json":
                names += [f"copies:{copied}", f"habit:{habit}:{closed}", f"habit:{habit}:{case}:{closed}"]
            got = self.others[key] = [_bit(kind, n) for n in names]
        if kind == "json":
            return got
        at = key, word
        both = self.words.get(at)
        if both is None:
            if len(self.words) > WORDS_HELD:
                self.words = {}
            if word is None:
                names = ["word:none"]
            else:
                stop, bare, seen = word
                names = [f"seen:{_level(seen)}", f"stop:{_share(stop, seen)}", f"bare:{_share(bare, seen)}", f"stops:{_level(stop)}", f"bares:{_level(bare)}"]
            both = self.words[at] = got + [_bit(kind, n) for n in [*(f"{f}:{closed}" for f in names), *(f"{f}:{closed}:{case}" for f in names[:3])]]
        return both


_AFTER = ["", "", "", "", "…", "...", ".", " ", " …", "\n"]
_AFTER_JSON = ["", "", "", "...\n```", "\n\n", "\n```", "…", "  ```"]


def artificially_cut(kind: str, text: str, rng: random.Random) -> list[tuple[str, str, bool, int]]:
    """Units of a value cut at a random place, with their lengths: prose, a caption, or an answer with its JSON."""
    if len(text.strip()) < 4:
        return []
    if kind == "json":
        start = _JSON.search(text)
        k = rng.randrange(2, len(text)) if rng.random() < 0.1 or not start else rng.randrange(start.start() + 1, max(start.start() + 2, len(text)))
        whole = start is not None and k > start.start() and json_end(text[:k], start.start()) is not None
        got = [] if whole else [(kd, tx, op) for kd, tx, op in units_of_answer(text[:k] + rng.choice(_AFTER_JSON)) if kd != "said"]
        return [(kd, tx, op, k) for kd, tx, op in got]
    body = text.rstrip().rstrip(_CLOSERS + _TERMINAL)
    if len(body) < 4:
        return []
    k = rng.randrange(max(2, len(body) // 4), len(body))
    cut = body[:k]
    if cut.rstrip()[-1:] in _TERMINAL:  # by chance at a sentence's end: no case
        return []
    after = rng.choice(_AFTER)
    return [(kind, cut + after, False, k + len(after))]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Logistic regression over hashed features."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def sums(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of the weights of rows whose features (none is without) stand one after another."""
        return np.add.reduceat(self.weights[flat].astype(float), np.cumsum(lengths) - lengths) if len(lengths) else np.empty(0)

    @staticmethod
    def fit(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, start: Model | None = None, damp: float = 0.15, ridge: float = 3.0) -> Model:
        """Full gradients, each weight's step scaled by its curvature; deterministic. ``start``: a model to go on from."""
        at = np.repeat(np.arange(len(lengths)), lengths)
        support = np.bincount(flat, minlength=WEIGHTS)
        flat, at = (x[support[flat] >= LEAST_SUPPORT] for x in (flat, at))  # what is rarer would only be learnt by heart
        used, flat = np.unique(flat, return_inverse=True)
        scale = damp * 0.3 / (0.25 * np.bincount(flat, weights=weight[at], minlength=len(used)) + ridge)
        w, speed = (start.weights[used].astype(float) if start else np.zeros(len(used))), np.zeros(len(used))
        for _ in range(steps):
            ahead = w + 0.9 * speed
            z = np.bincount(at, weights=ahead[flat], minlength=len(lengths))
            g = (logistic(z) - y) * weight
            grad = np.bincount(flat, weights=g[at], minlength=len(used)) + ridge * ahead
            speed = 0.9 * speed - scale * grad
            w += speed
        full = np.zeros(WEIGHTS)
        full[used] = w
        return Model(full)


def units(values: DataFrame) -> DataFrame:
    """UNIT rows of ``values`` (field, record_id, source, text, most): one per caption, several per output.

    field ``caption`` is taken as it is, any other as a model's output. Null and blank texts have no units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in UNIT.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for field, rid, source, text, most in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if field == "caption":
                    out.append((field, rid, source, "caption", text, False, len(text), most or 0, _same("caption", text), *local("caption", text, False)))
                    continue
                got = answers(text)
                for n, a in enumerate(got):
                    length = len(text) if n == len(got) - 1 else len(a)
                    for kind, t, o in units_of_answer(a):
                        own = kind == "said"
                        out.append((field, rid, source, kind, t, o, len(t) if own else length, 0 if own else most or 0, _same(kind, t), *local(kind, t, o)))
            for at in range(0, len(out), 5000):
                columns = list(zip(*out[at : at + 5000]))
                arrays = [pa.array(c, t) if k != _LOCAL else _lists(c) for k, (c, t) in enumerate(zip(columns, _TYPES))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    clean = values.where("text is not null and trim(text) <> ''")
    return clean.select("field", F.col("record_id").cast("bigint"), "source", "text", F.col("most").cast("bigint")).mapInArrow(run, UNIT)


def _lists(rows: Iterable[list[int]]) -> pa.ListArray:
    """Lists of small numbers as Arrow's, without looking at each as an object of its own type."""
    lengths = np.fromiter(map(len, rows), dtype=np.int32, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))))


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, COUNTS): the word statistics of all units, exact by key, counted inside the JVM and aggregated before each shuffle.

    A key whose counts are all too small to make a feature differ from that of an unknown one is left out.
    """
    zero, n = F.lit(0).cast("bigint"), F.count(F.lit(1))
    none = {c: zero.alias(c) for c in COUNTS}
    said = rows.where("kind <> 'json'")
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))).alias("token")
    tokens = said.select(token).groupBy("token").agg(n.alias("n"))
    word = F.rtrim("token", F.lit(_STOPS))
    short = F.when(F.right("token", F.lit(1)).rlike(_WIDE.pattern), F.right(F.col("token"), F.lit(3))).otherwise(F.col("token"))
    stopped = F.col("stopped")
    tokens = tokens.select(word.alias("token"), "n", (word != F.col("token")).alias("stopped"))
    inside = tokens.select(F.xxhash64(short).alias("key"), *(none | {"stop": F.when(stopped, F.col("n")).otherwise(zero).alias("stop"), "seen": F.col("n").alias("seen")}).values())
    # The last word of a value is what is asked about: it was counted above, and is taken away again.
    last = said.where("word is not null").groupBy(F.col("word").alias("key"), "closed").agg(n.alias("n"))
    last = last.select("key", *(none | {"bare": F.when(F.col("closed"), zero).otherwise(F.col("n")).alias("bare"), "seen": (-F.col("n")).alias("seen")}).values())
    head = said.where("word is not null and head is not null").groupBy(F.col("head").alias("key"), "closed").agg(n.alias("n"))
    ended = F.when(F.col("closed"), F.col("n")).otherwise(zero)
    head = head.select("key", *(none | {"ended": ended.alias("ended"), "unended": (F.col("n") - ended).alias("unended")}).values())
    sums = inside.unionByName(last).unionByName(head).groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.where((F.greatest("stop", "bare", "seen") > 1) | (F.col("ended") + F.col("unended") >= LEAST_HABIT))


def copy_counts(rows: DataFrame) -> DataFrame:
    """(same, n): records with a unit of this text, exact; those too few to be copies are left out. A repeated delivery is no copy."""
    each = rows.where("same is not null").select("same", "field", "record_id").distinct()
    return each.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COPIES)


def with_limits(rows: DataFrame) -> DataFrame:
    """``most`` filled where it is 0: the length at which a source's values without a full stop pile up.

    A pile is a length found PILE times as often as those around it; a source without one has no limit.
    """
    open_end = rows.where("kind = 'caption' and not rtrim(text) rlike '[.!?。！？][\"\\')\\\\]»”’）」』]*$'")
    piles = open_end.groupBy("source", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source").orderBy("length").rangeBetween(-4, 4)
    piles = piles.withColumn("around", (F.sum("n").over(near) - F.col("n")) / 8).where((F.col("n") >= PILE) & (F.col("n") >= PILE * F.col("around")))
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.desc("length"))
    limits = piles.withColumn("i", F.row_number().over(w)).where("i = 1").select("source", F.col("length").alias("pile"))
    at = F.when((F.col("kind") == "caption") & (F.col("most") == 0), F.coalesce("pile", F.lit(0))).otherwise(F.col("most"))
    return rows.join(limits, "source", "left").withColumn("most", at).drop("pile").select(*rows.columns)


def informed(rows: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (kind, closed, letters, length, most, same, word, head, own, ...) with what the statistics say of them: COUNTS of word and
    head, and ``others``, the copies besides the row itself (own: 1 if it is counted among them).

    Each statistic is joined by key, broadcast by the engine while it is small. Rows without a key match nothing; a salt
    keeps them from meeting in one task, and hot keys are left to the engine's splitting of skewed partitions.
    """
    salt = F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)).cast("bigint")
    flat = F.lit(0).cast("bigint")
    for key, table, columns in (
        ("word", words.withColumnRenamed("key", "word"), COUNTS[:3]), ("head", words.withColumnRenamed("key", "head"), COUNTS[3:]), ("same", counts, ["n"]),
    ):
        known = table.where(F.greatest(*columns, F.lit(0)) > 0).select(key, flat.alias("__salt"), *columns)
        rows = rows.withColumn("__salt", F.when(F.col(key).isNull(), salt).otherwise(flat)).join(known, [key, "__salt"], "left").drop("__salt")
    zero = F.lit(0).cast("bigint")
    filled = {c: F.coalesce(c, zero) for c in COUNTS}
    return rows.withColumns(filled | {"others": F.coalesce(F.col("n") - F.col("own"), zero)}).drop("n")


#: What is read of a row, in order, beside its local features.
_READ = ["kind", "closed", "letters", "length", "most", "others", "word", *COUNTS]


def _told(stats: Statistics, batch: pa.RecordBatch) -> Iterator[list[int]]:
    """The features that the statistics give to each row of a batch that has the columns of _READ."""
    for kind, closed, case, length, most, others, word, stop, bare, seen, ended, unended in zip(*(batch.column(c).to_pylist() for c in _READ)):
        yield stats.features(kind, closed, case, length, most, others, None if word is None else (stop, bare, seen), (ended, unended))


def examples(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Training examples: some ``sample`` units of each kind as they are stored (y = 0), and cut at a random place (y = 1).

    The sample is the rows whose hash is below a threshold, from the kinds' totals (four numbers): no task, and not the driver, sees more.
    """
    totals = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return rows.limit(0).select(*rows.columns, F.lit(0).cast("bigint").alias("own"), F.lit(0).alias("y"), F.lit(0).cast("bigint").alias("unit"))
    part = F.create_map(*[F.lit(x) for kind, n in totals.items() for x in (kind, sample / n)])
    h = F.xxhash64("text", "record_id")
    picked = rows.where(F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40) < F.element_at(part, F.col("kind")))
    names = [c.split()[0] for c in UNIT.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for *unit, seed in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((*unit, 1, 0, seed))
                field, rid, source, kind, text, is_open, _, limit, *_ = unit
                rng = random.Random(seed)
                for cut, text_, open_, length in artificially_cut(kind, text, rng):
                    most = length if limit and rng.random() < 0.3 else limit
                    out.append((field, rid, source, cut, text_, open_, length, most, _same(cut, text_), *local(cut, text_, open_), 0, 1, seed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*_TYPES, pa.int64(), pa.int32(), pa.int64()])], [*names, "own", "y", "unit"])

    return picked.select(*names, h.alias("unit")).mapInArrow(make, UNIT + ", own bigint, y int, unit bigint")


def train(rows: DataFrame, words: DataFrame, counts: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``examples``. The driver gets each example's features, as numbers: some 90,000 rows of about 40."""
    made = Scratch(rows.sparkSession, "truncation").write(examples(rows, sample), "examples")
    told = informed(made.drop("text"), words, counts)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Statistics()
        for batch in batches:
            rows_ = [a + b for a, b in zip(batch.column("local").to_pylist(), _told(stats, batch))]
            yield pa.RecordBatch.from_arrays([_lists(rows_), batch.column("y"), batch.column("unit")], ["bits", "y", "unit"])

    got = told.select(*_READ, "local", "y", "unit").mapInArrow(bits, "bits array<int>, y int, unit bigint").orderBy("unit", "y", F.hash("bits")).toArrow()
    lists = got.column("bits").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, lengths = lists.flatten().to_numpy().astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    y = got.column("y").to_numpy().astype(float)
    if not (y == 1).any():
        return Model(np.zeros(WEIGHTS) - 1)
    _, group = np.unique(got.column("unit").to_numpy(), return_inverse=True)
    weight, fold = np.ones(len(y)), group % FOLDS
    of = np.repeat(fold, lengths)
    parts = [(np.flatnonzero(fold == k), flat[of == k], lengths[fold == k], np.flatnonzero(fold != k), flat[of != k], lengths[fold != k]) for k in range(FOLDS)]
    models: list[Model | None] = [None] * FOLDS
    for turn in range(CLEANINGS):  # stored values that are cut themselves are found by models that haven't seen them
        p = np.zeros(len(y))
        for k, (here, own, n, rest, others, m) in enumerate(parts):
            if len(here) and len(rest):
                models[k] = Model.fit(others, m, y[rest], weight[rest], 60 if turn == 0 else 30, models[k])
                p[here] = logistic(models[k].sums(own, n))
        weight = np.where((y == 0) & (p > CUT_AT), 0.0, 1.0)
    return Model.fit(flat, lengths, y, np.where(y == 1, CUT_WEIGHT, weight))


def scored(values: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Units with ``p``, the model's probability that they are cut, and ``cut``.

    ``values``: field, record_id, source, text, most (a known limit, or null). A repeated row is scored again.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "truncation")
    rows = scratch.write(units(values), "units")
    words, counts = together(spark, lambda: scratch.write(word_counts(rows), "words"), lambda: scratch.write(copy_counts(rows), "copies"))
    rows = with_limits(rows)
    shared = spark.sparkContext.broadcast(train(rows, words, counts, sample).weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stats = Model(shared.value), Statistics()
        for batch in batches:
            here = batch.column("local")
            z = own.sums(here.flatten().to_numpy(), here.value_lengths().to_numpy())
            # Units with the same statistics share a list of features, and so its sum.
            known: dict[int, float] = {}
            lists = list(_told(stats, batch))
            for bits in lists:
                if id(bits) not in known:
                    known[id(bits)] = float(own.weights[bits].sum())
            z += np.fromiter((known[id(bits)] for bits in lists), dtype=float, count=len(lists))
            kept = ["field", "record_id", "source", "open", "kind"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(logistic(z))], [*kept, "p"])

    told = informed(rows.drop("text").withColumn("own", F.lit(1).cast("bigint")), words, counts)
    out = told.select("field", "record_id", "source", "open", *_READ, "local").mapInArrow(run, "field string, record_id bigint, source string, open boolean, kind string, p double")
    return out.withColumn("cut", F.col("p") >= CUT_AT)


def cut_records(rows: DataFrame) -> DataFrame:
    """(field, record_id) with a cut unit. ``rows``: scored units."""
    return rows.where("cut").select("field", "record_id").distinct()


def cut_rates(rows: DataFrame) -> DataFrame:
    """Per field and source: records with a text, cut ones, and their share."""
    each = rows.groupBy("field", "source", "record_id").agg(F.max("cut").alias("cut"))
    return each.groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n"))
