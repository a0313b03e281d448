"""JSON values as variants: reading bodies and running a bottom-up tree automaton over them, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How often a body may be JSON text inside a JSON string before it counts as unreadable.
NESTED_TEXTS = 3


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row, however often later expressions use them.

    Projections are merged by the optimizer, which copies an expression into each use and even into lambdas, where it
    would run per element. A generator is no projection: what it makes is read, not computed again.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_readable(df: DataFrame, body: str, name: str) -> DataFrame:
    """The rows of ``df`` whose column ``body`` holds an object, which they get as a variant ``name``.

    Accepted forms: plain JSON, a leading byte order mark, a Markdown fence around it, and JSON text inside a JSON string
    (up to NESTED_TEXTS times). Cut, blank and null bodies, JSON null, scalars, arrays, and objects that repeat a key
    are not readable.
    """
    text = F.regexp_replace(body, "^[\\s\ufeff]*(?:```[A-Za-z]*\\s*)?", "")
    df = once(df, __text=text)
    for _ in range(NESTED_TEXTS):
        again = F.regexp_replace(F.try_variant_get(F.try_parse_json("__text"), "$", "string"), "^[\\s\ufeff]+", "")
        df = df.withColumn("__text", F.when(F.col("__text").startswith('"'), again).otherwise(F.col("__text")))
    return once(df.where("__text is not null"), **{name: F.try_parse_json("__text")}).where(kind(F.col(name)) == "OBJECT").drop("__text")


def kind(v: Column) -> Column:
    """The type a variant holds: OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null) or one of the numbers' names."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def json_type(v: Column) -> Column:
    """The JSON type of a variant: null, boolean, number, string, array or object (null for no variant)."""
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(v.isNotNull(), F.coalesce(F.element_at(table, kind(v)), F.lit("number")))


def flat_state(v: Column) -> Column:
    """The automaton's state of a value without looking into objects: its JSON type or, of an array, the one its non-null
    elements agree on: ``strings``, ``numbers`` or ``booleans``; else (empty, mixed, nested) ``array``."""
    inside = F.array_distinct(F.transform(F.try_variant_get(v, "$", "array<variant>"), json_type))
    inside = F.array_remove(F.array_compact(inside), "null")
    plain = F.create_map(*[F.lit(x) for pair in (("string", "strings"), ("number", "numbers"), ("boolean", "booleans")) for x in pair])
    one = F.when(F.size(inside) == 1, F.element_at(plain, F.get(inside, 0)))
    own = json_type(v)
    return F.when(own == "array", F.coalesce(one, F.lit("array"))).otherwise(own)


def state(v: Column, members: list[tuple[str, str]]) -> Column:
    """The state a bottom-up tree automaton reaches at the root of a value.

    Leaves and arrays have the states of ``flat_state``. An object's is made from those its members have reached: it names,
    of ``members`` (key, state), the transitions that hold, as in ``object(bbox:numbers,node_id:string)``; none: ``object()``.
    So there are 2 ** len(members) states of objects, whatever other members they have (see ``states``).
    """
    seen = [F.when(flat_state(F.try_variant_get(v, f"$.{key}", "variant")) == want, f"{key}:{want}") for key, want in sorted(members)]
    of_object = F.concat(F.lit("object("), F.concat_ws(",", *seen), F.lit(")")) if seen else F.lit("object()")
    own = flat_state(v)
    return F.when(own == "object", of_object).otherwise(own)


def states(members: list[tuple[str, str]]) -> list[str]:
    """All states there are."""
    named = [f"{key}:{want}" for key, want in sorted(members)]
    objects = ["object(" + ",".join(x for k, x in enumerate(named) if n >> k & 1) + ")" for n in range(1 << len(named))]
    return ["null", "boolean", "number", "string", "array", "strings", "numbers", "booleans", *objects]


def elements(v: Column, path: str) -> Column:
    """The elements of an array at a path, null elements included; an empty array where there is no array."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def entries(v: Column, path: str) -> Column:
    """Key and value of the members of an object at a path; an empty array where there is no object."""
    return F.coalesce(F.map_entries(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))


def absent(v: Column) -> Column:
    """No value, or JSON null."""
    return v.isNull() | F.is_variant_null(v)
