"""Text expressions. Every function takes and returns a Column; null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenarium import dims
from scenarium.dims import lookup


def normalised(c: Column) -> Column:
    """Spaces trimmed, lower case, ``_`` replaced by a space (punctuation is kept)."""
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))


def reference_key(c: Column) -> Column:
    """An id as it is compared: spaces trimmed, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def ascii_folded(c: Column) -> Column:
    """Lower case ASCII words: everything but a-z, 0-9 becomes a space, spaces become single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9\\s]", " "), "\\s+", " "))


def scene_label(c: Column) -> Column:
    """A scene class as text: trimmed, lower case, ``_`` and ``/`` as spaces."""
    return F.translate(F.lower(F.trim(c)), "_/", "  ")


def label_or(c: Column, default: str) -> Column:
    """``normalised``, or a default for null and empty ones."""
    return F.coalesce(F.nullif(normalised(c), F.lit("")), F.lit(default))


def embedding_label(c: Column) -> Column:
    """``normalised`` with ``-`` and ``/`` as spaces too, spaces single."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(c)), "_-/", "   "), "\\s+", " "))


def unit_confidence(c: Column, default: float = 0.0) -> Column:
    """A number from whatever holds one, within 0 and 1; a default where there is none, 0 for NaN."""
    x = F.coalesce(c.try_cast("double"), F.lit(default))
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def canonical(c: Column, aliases: Column) -> Column:
    """``ascii_folded`` replaced by what a MAP of aliases says, or itself."""
    folded = ascii_folded(c)
    return F.coalesce(F.element_at(aliases, folded), folded)


def singular_word(w: Column) -> Column:
    """The singular of an English word, by exceptions, then suffixes."""
    fixed = lookup(dims.IRREGULAR_SINGULARS, w)
    keeps = w.isin(dims.INVARIANT_NOUNS) | (F.length(w) <= 3) | ~w.endswith("s") | w.rlike("(ss|us)$")
    return (
        F.when(fixed.isNotNull(), fixed)
        .when(keeps, w)
        .when(w.rlike("(sses|xes|ches|shes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .otherwise(F.regexp_replace(w, "s$", ""))
    )


def singular_phrase(c: Column) -> Column:
    """Every word of a phrase in the singular, joined by single spaces."""
    words = F.filter(F.split(c, "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, singular_word), " ")


def segments(c: Column) -> Column:
    """Punctuation-delimited parts, folded and joined by `` | ``, which no phrase can match across."""
    return F.array_join(F.transform(F.split(c, "[,.;:!?()]"), ascii_folded), " | ")


def without_scene(folded: Column, label: Column) -> Column:
    """A folded caption with the (folded, singular) part of the scene label before ``/`` replaced by a separator."""
    name = singular_phrase(ascii_folded(F.replace(F.split(label, "/")[0], F.lit("_"), F.lit(" "))))
    return F.when(F.coalesce(name, F.lit("")) == "", folded).otherwise(F.regexp_replace(folded, F.concat(F.lit("\\b"), name, F.lit("\\b")), F.lit(" | ")))


def detectable_term(c: Column) -> Column:
    """A term of a rule: ``_`` and ``...`` as spaces, parentheses dropped, spaces single, outer dots gone, lower case."""
    x = F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), "\\([^)]*\\)", " ")
    x = F.regexp_replace(F.replace(x, F.lit("..."), F.lit(" ")), "\\s+", " ")
    return F.lower(F.regexp_replace(x, "^[ .]+|[ .]+$", ""))


def prompt_labels(c: Column) -> Column:
    """The labels of a detector prompt: split at ``. ; ,`` and line ends, without leading articles, each once, in order."""
    parts = F.transform(F.split(c, "[.;,\\n]+"), lambda p: F.regexp_replace(F.trim(F.lower(p)), "^(a|an|the)\\s+", ""))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def english_list(items: Column, oxford: bool = True) -> Column:
    """``a``, ``a and b``, ``a, b, and c`` (or without the last comma); empty text for an empty list."""
    n = F.size(items)
    end = ", and " if oxford else " and "
    long = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(end), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.array_join(items, " and ")).otherwise(long)


def with_article(label: Column, count: Column) -> Column:
    """``a dog``, ``an owl``, ``3 dogs``; the label alone where the count is null."""
    article = F.when(F.substring(F.lower(label), 1, 1).isin(*"aeiou"), "an ").otherwise("a ")
    return F.when(count.isNull(), label).when(count > 1, F.concat(count.cast("string"), F.lit(" "), label, F.lit("s"))).otherwise(F.concat(article, label))


def sound_phrase(name: Column, count: Column) -> Column:
    """The part of a node's name before the first comma, in lower case: plural for several, with an article for one."""
    label = F.lower(F.trim(F.split(name, ",")[0]))
    article = F.when(F.substring(label, 1, 1).isin(*"aeiou"), "an ").otherwise("a ")
    return F.when(count.isNull(), label).when(count > 1, F.concat(label, F.lit("s"))).otherwise(F.concat(article, label))


def verb_form(verb: Column) -> Column:
    v = F.lower(F.trim(verb))
    return F.coalesce(lookup(dims.VERB_FORMS, v), v)


def scene_phrase(label: Column, indoor_outdoor: Column) -> Column:
    """``a market scene``, or ``an outdoor market scene`` where that is known."""
    name = F.replace(F.trim(label), F.lit("_"), F.lit(" "))
    known = F.coalesce(indoor_outdoor, F.lit("")) != ""
    return F.when(known & (indoor_outdoor != "unknown"), F.concat(F.lit("an "), indoor_outdoor, F.lit(" "), name, F.lit(" scene"))).otherwise(F.concat(F.lit("a "), name, F.lit(" scene")))


def finished_caption(sentences: Column) -> Column:
    """Sentences trimmed, each with one full stop, joined; a default where none is left."""
    bare = F.filter(F.transform(sentences, lambda s: F.regexp_replace(F.trim(s), "\\.+$", "")), lambda s: s != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(bare, lambda s: F.concat(s, F.lit("."))), " "), F.lit("")), F.lit("A visual scene."))


def one_line_caption(c: Column) -> Column:
    """A model's caption: outer quotes off, first line, a full stop at the end; a default where it is empty."""
    x = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    x = F.trim(F.element_at(F.split(x, "\\R"), 1))
    return F.when(F.coalesce(x, F.lit("")) == "", "A visual scene.").when(x.endswith("."), x).otherwise(F.concat(x, F.lit(".")))


def count_bin(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single").when(n <= 3, "few").when(n <= 10, "group").otherwise("dense")


def natural_order(c: Column) -> list[Column]:
    """Sort keys: decimal ids by number, then the others by text."""
    digits = c.rlike("^\\d+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, c.try_cast("decimal(38,0)")), c]


def data_url(content: Column, suffix: Column) -> Column:
    """An image's bytes as a data URL."""
    kind = F.when(F.lower(suffix) == "png", "image/png").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def path_condition(path: Column) -> Column:
    """(detector, scene_model, captioner) that a prediction's path names: by its folder, or the one above json and legacy."""
    parts = F.split(path, "/")
    up = lambda k: F.when(F.size(parts) >= k, F.element_at(parts, -k)).otherwise("")
    folder = up(2)
    detector = F.when(folder.startswith("grounding_dino_"), "grounding_dino").when(folder.startswith("owlv2_"), "owlv2").otherwise("unknown")
    model = (
        F.when(detector != "unknown", F.replace(folder, F.concat(detector, F.lit("_")), F.lit("")))
        .when(folder.isin("json", "legacy"), up(3))
        .otherwise("unknown")
    )
    captioner = F.when(path.contains("captions_gemma"), "gemma").otherwise("template")
    return F.struct(detector.alias("detector"), model.alias("scene_model"), captioner.alias("captioner"))
