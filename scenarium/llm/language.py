"""Missing or wrong language labels, by interpolated Kneser-Ney character models.

One model per language is trained on a bounded sample of labelled texts, sentence by sentence. Labels are partly wrong:
after a first training, sentences another language's model explains better are left out and the models trained again.
All models share sorted hash arrays, one per order, with a column of log-probabilities per language: a character costs
one or two binary searches for all languages together.

Texts are cut into sentences; lists, JSON, paths and numbers between them are of no language. A sentence gets the
language of the lowest cross-entropy per character, unless that is above what the language's own held-out sentences reach
(calibrated rejection). Sentences of one language in a row make a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 5
#: Bounds of the training sample, per label: texts (those with the smallest hash of their id), and characters of them together.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 120_000
#: A label needs this many texts to become a language.
LEAST_TEXTS = 5
#: Letters a sentence needs to be judged by itself.
LEAST_LETTERS = 8
#: Different letters it needs, and confidence: less is of no language.
LEAST_VARIETY, LEAST_CONFIDENCE = 4, 0.5
#: Held-out quantile of cross-entropy, and nats above it, from which a sentence is rejected.
REJECT_QUANTILE, REJECT_ABOVE = 0.99, 0.6
#: Whole sentences of a language that make a text mixed, if two languages have them.
MIXED_SENTENCES = 2

#: Two-letter codes of languages (ISO 639-1), and other names of those met most.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt "
    "lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn "
    "so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
NAMES = {
    "en": ["eng", "english"], "es": ["spa", "spanish", "castilian"], "pt": ["por", "portuguese"], "fr": ["fra", "fre", "french"], "de": ["deu", "ger", "german"],
    "it": ["ita", "italian"], "nl": ["nld", "dut", "dutch", "flemish"], "ru": ["rus", "russian"], "ja": ["jpn", "japanese"], "zh": ["zho", "chi", "chinese"],
    "ko": ["kor", "korean"], "pl": ["pol", "polish"], "sv": ["swe", "swedish"], "da": ["dan", "danish"], "no": ["nor", "norwegian"], "fi": ["fin", "finnish"],
    "tr": ["tur", "turkish"], "ar": ["ara", "arabic"], "uk": ["ukr", "ukrainian"], "cs": ["ces", "cze", "czech"], "el": ["ell", "gre", "greek"], "ca": ["cat", "catalan"],
}


def label_code(label: Column) -> Column:
    """The two-letter code a label names, whatever its case, spaces, region or form; null if it names no language."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for name in [code, *names] for x in (name, code)])
    return F.coalesce(F.element_at(table, bare), F.when(bare.isin(CODES), bare))


_WORD_ITEM = r"[^\W\d_][\w'’-]*"
_ITEM = rf"{_WORD_ITEM}(?: {_WORD_ITEM}){{0,3}}"  # a label: up to four words
_LABELS = re.compile(rf"\s*{_ITEM}(?:\s*[,;|]\s*{_ITEM})+\s*[,;|]?\s*")  # a list of them
_FIRST, _MIDDLE, _LAST = re.compile(rf"{_ITEM}\Z"), re.compile(_ITEM), re.compile(rf"{_ITEM}(?=\W|\Z)")
_FENCED = re.compile(r"```[\s\S]*?```")
_TAG = re.compile(r"<[^<>\s]+>(?:\[[A-Z]+\])?")
_MARK = re.compile(r'[{}\[\]()"]')
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_DATA = re.compile(r"""\s*(?:["'\[{]|-?\d|[\w-]+\s*[:=]|\Z)""")
_STOP = re.compile("[.!?…。！？\r\n\x0b\x0c\x85\u2028\u2029]+[\"'”»)\\]」』]*\\s*")
_DASHES = re.compile(r"\s-{2,}\s")
_ENDS, _WIDE, _LINES, _CLOSERS = ".!?…。！？", set("。！？"), set("\r\n\x0b\x0c\x85\u2028\u2029"), "\"'”»)]」』"
_DROP = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff\u00ad"))
_CLOSES = {"}": "{", "]": "[", ")": "("}


def _groups(text: str) -> list[tuple[int, int]]:
    """(start, end) of all pairs of brackets, in one pass; inside braces and square brackets, quoted strings are skipped."""
    held: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    m = _MARK.search(text)
    while m:
        ch, after = m.group(), m.end()
        if ch == '"':
            if held and held[-1][0] != "(" and (s := _STRING.match(text, m.start())):
                after = s.end()
        elif ch not in _CLOSES:
            held.append((ch, m.start()))
        elif held and held[-1][0] == _CLOSES[ch]:
            found.append((held.pop()[1], after))
        m = _MARK.search(text, after)
    return sorted(found)


def _is_data(inner: str, bracket: str) -> bool:
    """Whether what brackets hold is data: JSON or an assignment in braces or square brackets, one token in square brackets, a list of labels in any."""
    if bracket != "(" and (_DATA.match(inner) or bracket == "[" and len(inner.split()) == 1):
        return True
    return _LABELS.fullmatch(inner) is not None


def _without_data(text: str) -> str:
    """``text`` with spaces for code, JSON, lists of labels and tags, of any length. Only texts with the sign of a form are
    searched for it, each in one pass."""
    spans: list[tuple[int, int]] = []
    if "```" in text:
        spans += [m.span() for m in _FENCED.finditer(text)]
    if "{" in text or "[" in text or "(" in text:
        end = 0
        for start, stop in _groups(text):
            if start >= end and _is_data(text[start + 1 : stop - 1], text[start]):
                spans.append((start, stop))
                end = stop
    if "<" in text:
        spans += [m.span() for m in _TAG.finditer(text)]
    if spans:
        out, at = [], 0
        for start, end in sorted(spans):
            start = max(start, at)
            if end > start:
                out += [text[at:start], " " * (end - start)]
                at = end
        text = "".join([*out, text[at:]])
    return _without_piped(text) if "|" in text else text


def _without_piped(text: str) -> str:
    """``text`` with spaces for lists whose labels ``|`` separates: looked at from each of these signs, not from each word."""
    parts = text.split("|")
    open_ = False  # whether the part before ended within a list
    for k in range(len(parts) - 1):
        left = parts[k]
        if not open_:
            tail = " ".join(left.rsplit(" ", 4)[-4:])
            m = _FIRST.search(tail)
            if m:
                n = len(tail) - m.start()
                parts[k] = left[: len(left) - n] + " " * n
                open_ = True
        if open_:
            right = parts[k + 1]
            if k + 1 < len(parts) - 1 and (not right or _MIDDLE.fullmatch(right)):
                parts[k + 1] = " " * len(right)
                continue
            m = _LAST.match(right)
            if m:
                parts[k + 1] = " " * m.end() + right[m.end() :]
            open_ = False
    return "|".join(parts)  # the signs themselves go with the runs they are in


#: By code below 128: 1 where it is the sign of a path, an id or an assignment, 2 a digit, 4 printable, 8 white space.
_SIGNS = np.zeros(129, dtype=np.uint8)
_SIGNS[33:127] |= 4
_SIGNS[[ord(c) for c in "/\\_=|@#"]] |= 1
_SIGNS[48:58] |= 2
_SIGNS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] |= 8


def blanked(texts: list[str]) -> list[str]:
    """Texts with spaces for what is of no language: data in brackets, lists, tags (``_without_data``), and runs of printable ASCII
    with the sign of a path, an id or an assignment, or with several digits before white space or the end. Places stay."""
    texts = [_without_data(t) for t in texts]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _SIGNS[np.minimum(codes, 128)]
    found = np.flatnonzero((kinds & 3) != 0)
    if not len(found):
        return texts
    inside = np.concatenate([[0], (kinds & 4) != 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    run = np.searchsorted(starts, found, side="right") - 1
    signs = np.bincount(run, weights=kinds[found] & 1, minlength=len(starts))
    digits = np.bincount(run, weights=(kinds[found] & 2) != 0, minlength=len(starts))
    bad = (signs > 0) | (digits > 1) & ((kinds[ends] & 8) != 0)
    change = np.zeros(len(codes) + 1, dtype=np.int8)
    change[starts[bad]] += 1
    change[ends[bad]] -= 1
    hidden = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    clean = np.where(hidden, np.uint32(32), codes).tobytes().decode("utf-32-le", "surrogatepass")
    at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    touched = np.add.reduceat(hidden, at[:-1]) > 0
    return [clean[at[i] : at[i + 1] - 1] if x else t for i, (t, x) in enumerate(zip(texts, touched))]


def sentences(clean: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, sentence, whole) of a blanked text."""
    if "--" in clean:
        clean = _DASHES.sub(lambda m: "\n" * (m.end() - m.start()), clean)
    out, at, n = [], 0, len(clean)
    for m in _STOP.finditer(clean):
        g, after = m.group(), m.end()
        bare = g.rstrip().rstrip(_CLOSERS)
        if g[-1].isspace() or after == n or not _LINES.isdisjoint(g):
            end = m.start() + len(bare.rstrip())
        elif not _WIDE.isdisjoint(g):
            end = m.start() + len(bare)
        else:
            continue
        piece = clean[at:end]
        s = piece.strip()
        if s:
            start = at + len(piece) - len(piece.lstrip())
            out.append((start, start + len(s), s, s[-1] in _ENDS))
        at = after
    piece = clean[at:]
    s = piece.strip()
    if s:
        start = at + len(piece) - len(piece.lstrip())
        out.append((start, start + len(s), s, s.rstrip(_CLOSERS)[-1:] in _ENDS and s.rstrip(_CLOSERS) != ""))
    return out


def folded(s: str) -> str:
    """A sentence as the models see it: compatible forms united, lower case, digits as one, spaces single."""
    if s.isascii():
        s = s.lower()
    else:
        s = s.translate(_DROP)
        s = (s if unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)).casefold()
    if not _DIGITS.isdisjoint(s):
        s = re.sub(r"\d+", "0", s)
    return f" {' '.join(s.split())} "


_DIGITS = set("0123456789")


def _hashes(codes: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n characters ending at each place; 0 where they would reach beyond the sentence.

    ``first``: places of a character within its sentence.
    """
    out = []
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = mixed.copy()
        for n in range(1, order + 1):
            if n > 1:
                before = np.zeros_like(h)
                before[1:] = out[-1][:-1]
                h = (before * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)) ^ mixed
                h ^= h >> np.uint64(31)
                h = np.where(first >= n - 1, h | np.uint64(1), np.uint64(0))
            else:
                h = h | np.uint64(1)
            out.append(h)
    return out


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, place within its text, lengths) of texts one after another."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, np.arange(len(codes)) - starts, lengths


@dataclass
class Models:
    """Per order: sorted hashes of n-grams with log-probabilities, and of contexts with back-off weights, by language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: np.ndarray
    limits: np.ndarray

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character (nats) of each text by each language; texts are folded ones."""
        total = np.zeros((len(texts), len(self.languages)))
        block: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            block.append(i)
            size += len(t)
            if size > 200_000 or i == len(texts) - 1:
                total[block] = self._block([texts[k] for k in block])
                block, size = [], 0
        return total

    def _block(self, texts: list[str]) -> np.ndarray:
        codes, place, lengths = _stream(texts)
        h = _hashes(codes, place, ORDER)
        n = len(codes)
        score = np.zeros((n, len(self.languages)), dtype=np.float32)
        rest = np.arange(n)
        for order in range(ORDER, 0, -1):
            keys, values = self.grams[order - 1]
            want = h[order - 1][rest]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[at] == want) & (want != 0)
            score[rest[hit]] += values[at[hit]]
            rest = rest[~hit]
            if order > 1 and len(rest):
                keys, values = self.contexts[order - 2]
                # The context of a place is what ends one place before it.
                want = np.where(place[rest] >= order - 1, h[order - 2][rest - 1], np.uint64(0))
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = (keys[at] == want) & (want != 0)
                score[rest[hit]] += values[at[hit]]
        score[rest] += self.unseen
        ends = np.cumsum(lengths) - lengths
        return -np.add.reduceat(score, ends, axis=0) / lengths[:, None]


def train(texts: dict[str, list[str]]) -> Models:
    """Kneser-Ney models of folded sentences by language. Limits are left open (see ``calibrated``)."""
    languages = sorted(texts)
    per = []
    alphabet: set[int] = set()
    for lang in languages:
        codes, place, _ = _stream(texts[lang])
        alphabet.update(np.unique(codes).tolist())
        h = _hashes(codes, place, ORDER)
        before = [np.concatenate([[np.uint64(0)], x[:-1]]) for x in h]
        orders = []
        for n in range(1, ORDER + 1):
            ok = h[n - 1] != 0
            key, at, count = np.unique(h[n - 1][ok], return_index=True, return_counts=True)
            rows = np.flatnonzero(ok)[at]
            context = before[n - 2][rows] if n > 1 else np.zeros(len(rows), dtype=np.uint64)
            shorter = h[n - 2][rows] if n > 1 else None
            orders.append({"key": key, "count": count.astype(float), "context": context, "shorter": shorter})
        for n in range(ORDER - 1, 0, -1):  # below the top, an n-gram counts by the characters it follows
            longer = orders[n]
            key, kinds = np.unique(longer["shorter"], return_counts=True)
            kept = np.ones(len(orders[n - 1]["key"]))
            at = np.searchsorted(orders[n - 1]["key"], key)
            kept[at] = kinds
            orders[n - 1]["count"] = kept
        per.append(orders)
    size = len(alphabet) + 1
    for orders in per:
        for n, o in enumerate(orders):
            c = o["count"]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            key, back = np.unique(o["context"], return_inverse=True)
            total, kinds = np.bincount(back, weights=c), np.bincount(back)
            o["own"] = np.maximum(c - d, 0) / total[back]
            o["ckey"], o["gamma"] = key, d * kinds / total
            o["lambda"] = o["gamma"][back]
            if n == 0:
                o["p"] = o["own"] + o["lambda"] / size
            else:
                below = orders[n - 1]
                o["p"] = o["own"] + o["lambda"] * below["p"][np.searchsorted(below["key"], o["shorter"])]
    # Shared arrays: every n-gram of any language, with each language's interpolated probability.
    grams, contexts = [], []
    unseen = np.array([np.log(orders[0]["gamma"][0] / size) for orders in per], dtype=np.float32)
    for n in range(ORDER):
        keys = np.unique(np.concatenate([o[n]["key"] for o in per]))
        context = np.zeros(len(keys), dtype=np.uint64)
        shorter = np.zeros(len(keys), dtype=np.uint64)
        for orders in per:
            at = np.searchsorted(keys, orders[n]["key"])
            context[at] = orders[n]["context"]
            if n:
                shorter[at] = orders[n]["shorter"]
        values = np.empty((len(keys), len(languages)), dtype=np.float32)
        for k, orders in enumerate(per):
            o = orders[n]
            if n:
                below_keys, below = grams[n - 1]
                backed = below[np.searchsorted(below_keys, shorter), k].astype(float)
                at = np.minimum(np.searchsorted(o["ckey"], context), len(o["ckey"]) - 1)
                backed = backed + np.where(o["ckey"][at] == context, np.log(np.maximum(o["gamma"][at], 1e-12)), 0.0)
            else:
                backed = np.full(len(keys), unseen[k], dtype=float)
            at = np.searchsorted(keys, o["key"])
            backed[at] = np.log(o["p"])
            values[:, k] = backed
        grams.append((keys, values))
        if n:
            ckeys = np.unique(np.concatenate([o[n]["ckey"] for o in per]))
            weights = np.zeros((len(ckeys), len(languages)), dtype=np.float32)
            for k, orders in enumerate(per):
                o = orders[n]
                weights[np.searchsorted(ckeys, o["ckey"]), k] = np.log(np.maximum(o["gamma"], 1e-12))
            contexts.append((ckeys, weights))
    return Models(languages, grams, contexts, unseen, np.full(len(languages), np.inf))


def cleaned(texts: dict[str, list[str]], rounds: int = 2) -> dict[str, list[str]]:
    """Labelled sentences without those of another language.

    A conditional model learns even a few foreign sentences by heart, so it can't tell them. Their n-grams' shares can:
    in the texts of a wrong label, they are as rare as the wrong labels are.
    """
    for _ in range(rounds):
        names = sorted(texts)
        streams = {k: _stream(texts[k]) for k in names}
        grams = {k: _hashes(c, place, 3)[2] for k, (c, place, _) in streams.items()}
        tables = {}
        for k in names:
            key, n = np.unique(grams[k], return_counts=True)
            tables[k] = key, np.log(n / max(1, len(grams[k])))
        after = {}
        for k in names:
            lengths = streams[k][2]
            ends = np.cumsum(lengths) - lengths
            score = np.empty((len(lengths), len(names)))
            for j, other in enumerate(names):
                key, share = tables[other]
                at = np.minimum(np.searchsorted(key, grams[k]), len(key) - 1)
                score[:, j] = np.add.reduceat(np.where(key[at] == grams[k], share[at], -14.0), ends)
            best = score.argmax(axis=1)
            after[k] = [t for t, b in zip(texts[k], best) if names[b] == k]
        texts = {k: v for k, v in after.items() if len(v) >= LEAST_TEXTS}
    return texts


def calibrated(texts: dict[str, list[str]]) -> Models | None:
    """Models of labelled sentences with wrong ones left out, and limits from held-out sentences; None if none are left."""
    kept = cleaned({k: v for k, v in texts.items() if v})
    if not kept:
        return None
    part = {lang: [t for i, t in enumerate(v) if i % 5] or v for lang, v in kept.items()}
    trial = train(part)
    limits = []
    for k, lang in enumerate(trial.languages):
        held = [t for i, t in enumerate(kept[lang]) if i % 5 == 0] or kept[lang]
        limits.append(np.quantile(trial.entropies(held)[:, k], REJECT_QUANTILE) + REJECT_ABOVE)
    models = train(kept)
    models.limits = np.array(limits)
    return models


def label_counts(docs: DataFrame, label: str = "lang") -> DataFrame:
    """(code, n, trained): rows by the language their label names, and whether they are enough to become a language."""
    rows = docs.select(label_code(F.col(label)).alias("code")).where("code is not null")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("trained", F.col("n") >= LEAST_TEXTS)


def learn(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Models | None:
    """Models from a bounded sample of the labelled rows; None if no label has LEAST_TEXTS texts (``label_counts`` tells which have).

    The sample is taken at the scan by a threshold on the hash of the key, from the labels' totals; a label's rows beyond
    SAMPLE_TEXTS are not sent on. A document is cut into sentences by the tasks, so the driver gets SAMPLE_CHARS a label at most from each of its texts.
    """
    counts = {r.code: r.n for r in label_counts(docs, label).where("trained").toLocalIterator()}
    if not counts:
        return None
    # A tenth more than needed: what is blank or no sentence falls out.
    part = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(1.0, 1.1 * SAMPLE_TEXTS / n))])
    at = F.pmod(F.xxhash64(key), F.lit(1 << 31)).cast("double") / float(1 << 31)
    rows = docs.select(key, text, label_code(F.col(label)).alias("code")).where(F.col("code").isin(list(counts)))
    picked = rows.where((at < F.element_at(part, F.col("code"))) & (F.length(F.trim(text)) > 0))
    limit = SAMPLE_CHARS // 8  # of one text in the sample, so that one long text is not all of it

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, texts, codes = (batch.column(i).to_pylist() for i in range(3))
            for doc, clean, code in zip(ids, blanked([t[:limit] for t in texts]), codes):
                own = [t for t, whole in ((folded(s), whole) for _, _, s, whole in sentences(clean)) if whole and sum(map(str.isalpha, t)) >= LEAST_LETTERS]
                out.append((doc, code, own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[], [], []], (pa.int64(), pa.string(), pa.list_(pa.string())))], ["doc", "code", "said"])

    said = picked.select(F.col(key).cast("bigint"), text, "code").mapInArrow(cut, "doc bigint, code string, said array<string>")
    by: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    texts: dict[str, int] = {}
    for r in said.orderBy("code", F.xxhash64("doc"), "doc").toLocalIterator():
        if texts.get(r.code, 0) >= SAMPLE_TEXTS:
            continue
        texts[r.code] = texts.get(r.code, 0) + 1
        for t in r.said:
            if size.get(r.code, 0) < SAMPLE_CHARS:
                by.setdefault(r.code, []).append(t)
                size[r.code] = size.get(r.code, 0) + len(t)
    by = {k: v for k, v in by.items() if texts[k] >= LEAST_TEXTS}
    return calibrated(by) if by else None


def judged(models: Models, texts: list[str]) -> list[tuple[str | None, float]]:
    """(language, confidence) of each folded sentence; no language if all are rejected."""
    if not texts:
        return []
    ce = models.entropies(texts)
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(texts)), best]
    lengths = np.array([len(t) for t in texts])
    # Neighbouring characters are not independent: their evidence counts with the root of their number.
    weight = np.exp(-(ce - low[:, None]) * np.sqrt(lengths)[:, None] * 2)
    sure = 1 / weight.sum(axis=1)
    known = (low <= models.limits[best]) & (sure >= LEAST_CONFIDENCE)
    return [(models.languages[b] if k and len(set(filter(str.isalpha, t))) >= LEAST_VARIETY else None, float(p)) for b, k, p, t in zip(best, known, sure, texts)]


#: Of each document: its label's code, its segments in order, and its languages, the one with most letters first.
JUDGED = (
    "doc_id bigint, code string, segments array<struct<start:bigint,end:bigint,lang:string,confidence:double,sentences:int,letters:bigint>>, "
    "languages array<struct<lang:string,sentences:bigint,letters:bigint,confidence:double>>"
)
_SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("letters", pa.int64())]))
_LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("sentences", pa.int64()), ("letters", pa.int64()), ("confidence", pa.float64())]))
#: Documents judged at a time, and sentences whose verdicts a task remembers before it starts anew.
BLOCK, REMEMBERED = 1_000, 100_000


def documents(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """JUDGED rows, one per row of ``docs``, in one pass and without a shuffle.

    A segment is a run of sentences of one language; sentences counts whole ones; start and end are places in the text.
    Rejected sentences and what is no sentence belong to no segment; a short piece goes with the segment before it. A text
    with short pieces only is judged as one. Null and empty texts, and those without any language, have no segments.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield judge.block(batch.slice(at, BLOCK))

    return docs.select(F.col(key).cast("bigint"), text, label_code(F.col(label)).alias("code")).mapInArrow(run, JUDGED)


class _Judge:
    """Judges documents block by block; remembers, up to a bound, what it found of sentences that come again."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.pieces: dict[str, tuple[str, int, bool]] = {}
        self.verdicts: dict[str, tuple[str | None, float]] = {}

    def piece(self, s: str) -> tuple[str, int, bool]:
        """(folded, letters, whether it can be judged by itself) of a sentence."""
        got = self.pieces.get(s)
        if got is None:
            t = folded(s)
            letters = sum(map(str.isalpha, t))
            got = self.pieces[s] = t, letters, letters >= LEAST_LETTERS or letters > 0 and not t.isascii() and _dense(t)
        return got

    def block(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(self.pieces) > REMEMBERED or len(self.verdicts) > REMEMBERED:
            self.pieces, self.verdicts = {}, {}
        parts: list[list[tuple]] = []
        asked: dict[str, None] = {}
        for text in blanked([t or "" for t in batch.column(1).to_pylist()]):
            own = []
            for start, end, s, whole in sentences(text):
                t, letters, alone = self.piece(s)
                if letters:
                    own.append((start, end, letters, whole, t if alone else None))
            if own and all(t is None for *_, t in own):  # short pieces only: together they may be enough
                t = " " + " ".join(self.piece(text[start:end])[0].strip() for start, end, *_ in own) + " "
                own = [(own[0][0], own[-1][1], sum(x[2] for x in own), any(x[3] for x in own), t)]
            asked |= dict.fromkeys(t for *_, t in own if t is not None and t not in self.verdicts)
            parts.append(own)
        new = list(asked)
        self.verdicts |= zip(new, judged(self.models, new))
        runs = [self.runs(own) for own in parts]
        columns = [batch.column(0), batch.column(2), pa.array([_segment_rows(r) for r in runs], _SEGMENTS), pa.array([_language_rows(r) for r in runs], _LANGUAGES)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "segments", "languages"])

    def runs(self, own: list[tuple]) -> list[list]:
        """Runs of one language: start, end, language, confidence times letters, whole sentences, letters."""
        runs: list[list] = []
        for start, end, letters, whole, t in own:
            if t is None:
                if runs:
                    runs[-1][1] = end
                continue
            lang, sure = self.verdicts[t]
            if lang is None:
                continue
            if runs and runs[-1][2] == lang:
                r = runs[-1]
                r[1], r[3], r[4], r[5] = end, r[3] + sure * letters, r[4] + whole, r[5] + letters
            else:
                runs.append([start, end, lang, sure * letters, int(whole), letters])
        return runs


def _segment_rows(runs: list[list]) -> list[dict]:
    return [{"start": r[0], "end": r[1], "lang": r[2], "confidence": r[3] / r[5], "sentences": r[4], "letters": r[5]} for r in runs]


def _language_rows(runs: list[list]) -> list[dict]:
    sums: dict[str, list] = {}
    for _, _, lang, sure, whole, letters in runs:
        s = sums.setdefault(lang, [0, 0, 0.0])
        s[0], s[1], s[2] = s[0] + whole, s[1] + letters, s[2] + sure
    order = sorted(sums.items(), key=lambda x: (-x[1][1], x[0]))
    return [{"lang": lang, "sentences": s[0], "letters": s[1], "confidence": s[2] / s[1]} for lang, s in order]


def _dense(t: str) -> bool:
    """A script in which few characters say much."""
    return sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "가" <= c <= "힯" for c in t) >= 4


def segments(found: DataFrame) -> DataFrame:
    """(doc_id, seg, start, end, lang, confidence, sentences, letters) of JUDGED rows."""
    return found.select("doc_id", F.posexplode("segments").alias("seg", "s")).select("doc_id", "seg", "s.*")


def languages(found: DataFrame) -> DataFrame:
    """(doc_id, lang, sentences, letters, confidence, mixed, rnk) of JUDGED rows: each text's languages, the one with most letters first.

    mixed: at least MIXED_SENTENCES whole sentences in each of two or more languages.
    """
    many = F.size(F.filter("languages", lambda x: x["sentences"] >= MIXED_SENTENCES)) >= 2
    return found.select("doc_id", "code", many.alias("mixed"), F.posexplode("languages").alias("rnk", "l")).select("doc_id", "code", "l.*", "mixed", (F.col("rnk") + 1).alias("rnk"))


def issues(found: DataFrame) -> DataFrame:
    """(doc_id, issue, lang): ``mixed``, ``missing`` or ``wrong`` labels of JUDGED rows."""
    rows = languages(found).where(f"(mixed and sentences >= {MIXED_SENTENCES}) or (not mixed and rnk = 1)")
    issue = F.when(F.col("mixed"), "mixed").when(F.col("code").isNull(), "missing").when(F.col("code") != F.col("lang"), "wrong")
    return rows.select("doc_id", issue.alias("issue"), "lang").where("issue is not null").distinct()
