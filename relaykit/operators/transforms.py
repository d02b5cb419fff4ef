"""Field transforms: an ordered list of ``{op, path, args, phase}`` compiled to column expressions.

A path is dotted; ``name[]`` or ``name[*]`` means every element of an array and ``name[2]`` one element. Paths
are resolved against the DataFrame schema, so struct and array columns are edited in place, row by row in the JVM.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASKED = "*****"  # fixed value: text that replaces a redacted value
# Fixed value: characters that trimming removes, U+0001 to the space.
BLANKS = "".join(chr(c) for c in range(1, 33))
UUID_TEXT = r"^[0-9a-fA-F]{1,8}(-[0-9a-fA-F]{1,4}){3}-[0-9a-fA-F]{1,12}$"
UUID_WIDTHS = [8, 4, 4, 4, 12]
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
ZONED_STAMP = DATE_TIME + r"(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2}){1,2})$"
LOCAL_STAMP = DATE_TIME + r":\d{2}(\.\d{1,9})?$"
PHASES = ("both", "inference_only")


@dataclass(frozen=True)
class Step:
    name: str
    each: bool = False
    index: int | None = None

    @property
    def is_array(self) -> bool:
        return self.each or self.index is not None


def parse_path(path: str) -> list[Step]:
    steps = []
    for token in path.split("."):
        name, bracket = re.fullmatch(r"([^\[\]]+)(?:\[(\*|\d*)\])?", token).groups()
        steps.append(Step(name, bracket in ("", "*"), int(bracket) if bracket and bracket.isdigit() else None))
    return steps


def field_type(dtype: T.DataType, steps: list[Step]) -> T.DataType | None:
    """Type at a path below a struct or row type; None when the schema has no such field."""
    for step in steps:
        if not isinstance(dtype, T.StructType) or step.name not in dtype.fieldNames():
            return None
        dtype = dtype[step.name].dataType
        if step.is_array:
            if not isinstance(dtype, T.ArrayType):
                return None
            dtype = dtype.elementType
    return dtype


# ---- reading ------------------------------------------------------------------------------------------


def _field(parent: Column | None, name: str) -> Column:
    return F.col(f"`{name}`") if parent is None else parent[name]


def _all(parent: Column | None, steps: list[Step]) -> Column:
    """Array of the values a path matches; a null plain field is no match, a null element is one."""
    step, rest = steps[0], steps[1:]
    here = _field(parent, step.name)
    if not step.is_array:
        found = _all(here, rest) if rest else F.array(here)
        return F.when(here.isNotNull(), found)
    if step.each:
        if not rest:
            return here
        return F.flatten(F.filter(F.transform(here, lambda x: _all(x, rest)), lambda x: x.isNotNull()))
    inside = F.size(here) > step.index
    one = F.get(here, step.index)
    return F.when(inside, _all(one, rest) if rest else F.array(one))


def read_path(path: str) -> Column:
    """First non-null value a path matches."""
    steps = parse_path(path)
    if not any(s.is_array for s in steps):
        value = None
        for step in steps:
            value = _field(value, step.name)
        return value
    return F.get(F.filter(_all(None, steps), lambda x: x.isNotNull()), 0)


def match_count(path: str, cap: int | None = None) -> Column:
    steps = parse_path(path)
    count = F.coalesce(F.size(_all(None, steps)), F.lit(0))
    return count if cap is None else F.least(count, F.lit(cap))


# ---- editing ------------------------------------------------------------------------------------------

Edit = Callable[[Column, T.DataType], Column]


class _Cap:
    """Keeps the first ``limit`` matches of a path in document order."""

    def __init__(self, limit: int):
        self.limit = limit

    @staticmethod
    def count(value: Column, rest: list[Step]) -> Column:
        return F.coalesce(F.size(_all(value, rest)), F.lit(0)) if rest else F.lit(1)

    def last_index(self, array: Column, rest: list[Step], used: Column) -> Column:
        """Index of the last element that may be edited; null when the array holds fewer matches than are left.

        One pass over the array, for paths whose elements match at most once.
        """
        matched = F.transform(array, lambda x, i: F.when(self.count(x, rest) > 0, i))
        last = F.get(F.filter(matched, lambda i: i.isNotNull()), self.limit - 1 - used)
        return F.when(used < self.limit, last).otherwise(-1)

    def before(self, array: Column, i: Column, rest: list[Step], used: Column) -> Column:
        """Matches ahead of element ``i``, for paths with an inner wildcard."""
        return F.aggregate(F.slice(array, 1, i), used, lambda n, x: n + self.count(x, rest))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _edit(value: Column, dtype: T.DataType, steps: list[Step], edit: Edit, cap: _Cap | None, used: Column) -> Column:
    if not steps:
        return edit(value, dtype)
    step, rest = steps[0], steps[1:]
    child_type = field_type(dtype, [Step(step.name)])
    child = value[step.name] if child_type is not None else F.lit(None)
    return value.withField(f"`{step.name}`", _edit_child(child, child_type, step, rest, edit, cap, used))


def _edit_child(child, child_type, step: Step, rest: list[Step], edit: Edit, cap: _Cap | None, used: Column) -> Column:
    if not step.is_array:
        return _edit(child, child_type or T.NullType(), rest, edit, cap, used)
    element = child_type.elementType

    def each(array: Column, allowed: Callable[[Column], Column | None], offset: Callable[[Column], Column]) -> Column:
        def one(x: Column, i: Column) -> Column:
            edited, condition = _edit(x, element, rest, edit, cap, offset(i)), allowed(i)
            return edited if condition is None else F.when(condition, edited).otherwise(x)

        return F.transform(array, one)

    if not step.each:
        return each(child, lambda i: i == step.index, lambda i: used)
    if cap is None:
        return each(child, lambda i: None, lambda i: used)
    if any(s.each for s in rest):
        return each(child, lambda i: cap.before(child, i, rest, used) < cap.limit, lambda i: cap.before(child, i, rest, used))
    bound = F.struct(child.alias("array"), cap.last_index(child, rest, used).alias("last"))
    return _with(
        bound, lambda b: each(b["array"], lambda i: b["last"].isNull() | (i <= b["last"]), lambda i: used)
    )


def edit_path(df: DataFrame, path: str, edit: Edit, max_matches: int | None = None) -> DataFrame:
    """Replaces every value the path matches by ``edit(value, type)``."""
    first, *rest = parse_path(path)
    known = field_type(df.schema, [Step(first.name)])
    if max_matches == 0 or (known is None and (rest or first.is_array)):
        return df
    child = F.col(f"`{first.name}`") if known is not None else F.lit(None)
    cap = _Cap(max_matches) if max_matches is not None else None
    return df.withColumn(first.name, _edit_child(child, known, first, rest, edit, cap, F.lit(0)))


def _drop(df: DataFrame, steps: list[Step], max_matches: int | None = None) -> DataFrame:
    """Drops what the path matches; of array elements the first ``max_matches``. A struct that loses its only field goes too."""
    *parents, last = steps
    if max_matches == 0 or field_type(df.schema, steps) is None:
        return df
    if last.is_array:
        if last.each:
            cap = max_matches
            keep = (lambda x, i: F.lit(False)) if cap is None else (lambda x, i: i >= cap)
        else:
            keep = lambda x, i: i != last.index
        path = _text([*parents, Step(last.name)])
        return edit_path(df, path, lambda v, t: F.filter(v, keep))
    if not parents:
        return df.drop(last.name)
    holder = field_type(df.schema, parents)
    if isinstance(holder, T.StructType) and len(holder.fields) == 1:
        return _drop(df, parents, max_matches)
    return edit_path(df, _text(parents), lambda v, t: v.dropFields(f"`{last.name}`"), max_matches)


def _text(steps: list[Step]) -> str:
    return ".".join(s.name + ("[]" if s.each else f"[{s.index}]" if s.index is not None else "") for s in steps)


def _rename(df: DataFrame, path: str, to: str, max_matches: int | None = None) -> DataFrame:
    old, new = parse_path(path), parse_path(to)
    if old == new or field_type(df.schema, old) is None:
        return df
    common = 0
    while common < min(len(old), len(new)) - 1 and old[common] == new[common]:
        common += 1
    if any(s.is_array for s in old[common:] + new[common:]):
        raise ValueError(f"rename {path} to {to}: wildcards must be in the shared part of both paths")
    source, target = [s.name for s in old[common:]], [s.name for s in new[common:]]

    def take(value: Column | None) -> Column:
        for name in source:
            value = _field(value, name)
        return value

    def kept(known, value: Column, present: Callable[[], Column]) -> Column:
        """A source that is null leaves an existing target as it is."""
        return value if known is None else F.coalesce(value, present().try_cast(_type_of(df, old)))

    if common == 0:
        moved = _put(df, target, kept(field_type(df.schema, new), take(None), lambda: read_path(to)))
        return _drop(moved, old)

    def place(v: Column, t: T.DataType) -> Column:
        def present() -> Column:
            value = v
            for name in target:
                value = value[name]
            return value

        return _put_field(v, t, target, kept(field_type(df.schema, new), take(v), present))

    moved = edit_path(df, _text(old[:common]), place, max_matches)
    return _drop(moved, old, max_matches)


def _type_of(df: DataFrame, steps: list[Step]) -> T.DataType:
    return field_type(df.schema, steps)


def _put(df: DataFrame, names: list[str], value: Column) -> DataFrame:
    if len(names) == 1:
        return df.withColumn(names[0], value)
    known = field_type(df.schema, [Step(names[0])])
    parent = F.col(names[0]) if known is not None else None
    return df.withColumn(names[0], _put_field(parent, known, names[1:], value))


def _put_field(parent: Column | None, dtype, names: list[str], value: Column) -> Column:
    for_child = field_type(dtype, [Step(names[0])]) if parent is not None else None
    if len(names) > 1:
        child = parent[names[0]] if for_child is not None else None
        value = _put_field(child, for_child, names[1:], value)
    return F.struct(value.alias(names[0])) if parent is None else parent.withField(f"`{names[0]}`", value)


# ---- operations ---------------------------------------------------------------------------------------


def to_uuid(value: Column) -> Column:
    text = value.cast("string")
    parts = F.split(text, "-")
    padded = [F.lpad(F.get(parts, i), width, "0") for i, width in enumerate(UUID_WIDTHS)]
    return F.when(text.rlike(UUID_TEXT), F.lower(F.concat_ws("-", *padded)))


def to_decimal(value: Column, scale: int | None = None) -> Column:
    """Decimal rounded half up; null for text that is no number."""
    if scale is None:
        return value.cast("string").try_cast("decimal(38,9)")
    # One digit more than asked for would round twice; a cast to the target type rounds half up once.
    return value.cast("string").try_cast(f"decimal(38,{scale})")


def to_timestamp(value: Column, fmt: str | None = None, fmt_regex: str | None = None, zone: str = "UTC") -> Column:
    """Instant of a date-time text: the given format if its guard matches, else ISO with or without an offset."""
    text = F.btrim(value.cast("string"), F.lit(BLANKS))
    zoned = F.when(text.rlike(ZONED_STAMP), text.try_cast("timestamp"))
    # Wall-clock time moves from its zone to the session's, in which a cast reads it: the same instant in any session.
    instant = lambda wall: F.convert_timezone(F.lit(zone), F.current_timezone(), wall).cast("timestamp")
    iso = F.coalesce(zoned, instant(F.when(text.rlike(LOCAL_STAMP), text.try_cast("timestamp_ntz"))))
    if not fmt:
        return iso
    custom = F.coalesce(zoned, instant(F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")))
    return F.when(text.rlike(f"^(?:{fmt_regex})$"), custom).otherwise(iso) if fmt_regex else custom


def cast_value(value: Column, dtype: T.DataType, kind: str) -> Column:
    """Value in the named type; null when it does not convert (``cast_failures`` lists those values)."""
    kind = kind.lower()
    text = value.cast("string")
    numeric = isinstance(dtype, T.NumericType)
    if kind == "string":
        return text
    if kind in ("int", "int32", "int64"):
        digits = F.regexp_replace(text, "[^0-9.-]", "")
        return value.try_cast("bigint") if numeric else F.when(digits.rlike(r"^-?\d+$"), digits.try_cast("bigint"))
    if kind in ("float", "float64", "double"):
        return value.try_cast("double")
    if kind in ("bool", "boolean"):
        return value if isinstance(dtype, T.BooleanType) else F.lower(text) == "true"
    if kind == "decimal":
        return to_decimal(value)
    if kind == "uuid":
        return to_uuid(value)
    if kind == "timestamp":
        return to_timestamp(value)
    return value


def mask(value: Column, strategy: str = "redact", salt: str = "") -> Column:
    if strategy == "null":
        return F.lit(None).cast("string")
    if strategy == "hash":
        return F.sha2(F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit(salt)), 256)
    return F.lit(MASKED)


def _value_edit(op: str, args: dict) -> Edit | None:
    """Edit of a single matched value, for the operations that look at nothing else."""
    def text(fn: Callable[[Column], Column]) -> Edit:
        return lambda v, t: fn(v.cast("string"))

    if op == "trim":
        return text(lambda c: F.btrim(c, F.lit(BLANKS)))
    if op in ("lower", "upper"):
        return text(getattr(F, op))
    if op == "substring":
        start, length = int(args.get("start") or 0), args.get("length")
        end = F.lit(2**31 - 1 if length is None else int(length))
        return text(lambda c: F.substring(c, F.lit(start + 1), end))
    if op == "regex_extract":
        pattern, group = args.get("pattern") or ".*", int(args.get("group") or 0)
        return text(lambda c: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)))
    if op == "cast":
        return lambda v, t: cast_value(v, t, args.get("type", ""))
    if op == "to_uuid":
        return lambda v, t: to_uuid(v)
    if op == "to_decimal":
        return lambda v, t: to_decimal(v, args.get("scale"))
    if op == "to_timestamp":
        return lambda v, t: to_timestamp(v, args.get("format"), args.get("formatRegex"), args.get("timezone") or "UTC")
    if op == "parse_json":
        return lambda v, t: F.coalesce(F.try_parse_json(v.cast("string")), v.cast("variant"))
    return None


def apply_transform(df: DataFrame, spec: dict, max_matches: int | None = None) -> DataFrame:
    op, path, args = spec.get("op"), spec.get("path"), spec.get("args") or {}
    if not op or not path:
        return df
    steps = parse_path(path)
    if op == "drop":
        return _drop(df, steps, max_matches)
    if op == "rename":
        return _rename(df, path, args["to"], max_matches) if args.get("to") else df
    if op == "coalesce":
        sources = [read_path(p) for p in args.get("values", []) if field_type(df.schema, parse_path(p)) is not None]

        def first(v: Column, t: T.DataType) -> Column:
            return F.coalesce(v, *[s if isinstance(t, T.NullType) else s.try_cast(t) for s in sources])

        return edit_path(df, path, first, max_matches)
    if op == "default_if_missing":
        # An absent parent, or an array that is not there, has nothing to fill.
        if (len(steps) > 1 and field_type(df.schema, steps[:-1]) is None) or (steps[-1].is_array and field_type(df.schema, steps) is None):
            return df
        value = F.lit(args.get("value"))
        return edit_path(
            df, path, lambda v, t: F.coalesce(v, value if isinstance(t, T.NullType) else value.cast(t)), max_matches
        )
    if op == "concat":
        parts = [
            F.coalesce(read_path(p).cast("string"), F.lit(""))
            if field_type(df.schema, parse_path(p)) is not None
            else F.lit("")
            for p in args.get("paths", [])
        ]
        if field_type(df.schema, steps) is None:
            return df
        joined = F.concat_ws(args.get("sep") or "", *parts)
        # Only a value that is there is replaced.
        return edit_path(df, path, lambda v, t: F.when(v.isNotNull(), joined), max_matches)
    if field_type(df.schema, steps) is None:
        return df
    if op == "mask":
        element = steps[-1].is_array

        def hide(v: Column, t: T.DataType) -> Column:
            hidden = mask(v, args.get("strategy") or "redact", args.get("salt") or "")
            return hidden if element else F.when(v.isNotNull(), hidden)

        return edit_path(df, path, hide, max_matches)
    edit = _value_edit(op, args)
    return df if edit is None else edit_path(df, path, edit, max_matches)


def active(specs: list[dict]) -> list[dict]:
    return [s for s in specs if (s.get("phase") or "both") in PHASES]


def apply_transforms(df: DataFrame, specs: list[dict], max_matches: int | None = None) -> DataFrame:
    """Applies the transforms of the inference phase in order; ``max_matches`` bounds matches per row and transform."""
    for spec in active(specs):
        df = apply_transform(df, spec, max_matches)
    return df


def transform_stats(df: DataFrame, specs: list[dict], max_matches: int | None = None) -> DataFrame:
    """Matches per transform, each counted on the rows as the transform finds them: ``[step, op, path, matches]``."""
    specs = active(specs)
    for n, spec in enumerate(specs):
        steps = parse_path(spec["path"])
        if field_type(df.schema, steps) is None:
            counted = F.lit(0)
        elif spec["op"] == "default_if_missing":
            counted = F.when(read_path(spec["path"]).isNull(), 1).otherwise(0)
        else:
            counted = match_count(spec["path"], max_matches)
        df = apply_transform(df.withColumn(f"_matches{n}", counted), spec, max_matches)
    totals = df.agg(*[F.sum(f"_matches{n}").alias(f"m{n}") for n in range(len(specs))])
    rows = [
        F.struct(
            F.lit(n).alias("step"), F.lit(s["op"]).alias("op"), F.lit(s["path"]).alias("path"),
            F.coalesce(F.col(f"m{n}"), F.lit(0)).alias("matches"),
        )
        for n, s in enumerate(specs)
    ]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def observed_transforms(df: DataFrame, specs: list[dict], max_matches: int | None = None) -> tuple[DataFrame, Callable[[], list[dict]]]:
    """``apply_transforms`` that counts as it goes, and what reads the counts once the result has been computed.

    Counts: ``step, op, path, matches``, as ``transform_stats`` has them, and ``failures``, the values that a cast turned
    to null. They come from the one pass that computes the result; a result computed twice counts the first time.
    """
    seen, plan = Observation(f"transforms-{uuid.uuid4().hex}"), active(specs)
    own: list[str] = []
    for n, spec in enumerate(plan):
        steps = parse_path(spec["path"])
        dtype = field_type(df.schema, steps)
        failed = F.lit(0)
        if dtype is None:
            counted = F.lit(0)
        elif spec["op"] == "default_if_missing":
            counted = F.when(read_path(spec["path"]).isNull(), 1).otherwise(0)
        else:
            counted = match_count(spec["path"], max_matches)
        if dtype is not None and spec["op"] in ("cast", "to_uuid", "to_decimal", "to_timestamp"):
            failed = F.size(_failed(spec, _value_edit(spec["op"], spec.get("args") or {}), dtype))
        df = apply_transform(df.withColumns({f"_matches{n}": counted, f"_failures{n}": failed}), spec, max_matches)
        own += [f"_matches{n}", f"_failures{n}"]
    if not plan:
        return df, list
    done = df.observe(seen, *[F.sum(c).alias(c) for c in own]).drop(*own)

    def counts() -> list[dict]:
        found = seen.get
        return [{"step": n, "op": s["op"], "path": s["path"], "matches": found[f"_matches{n}"] or 0, "failures": found[f"_failures{n}"] or 0} for n, s in enumerate(plan)]

    return done, counts


def cast_failures(df: DataFrame, specs: list[dict], key: str) -> DataFrame:
    """Values that a cast, decimal, uuid or timestamp transform turns to null: ``[key, op, path, value]``."""
    lost = []
    for n, spec in enumerate(active(specs)):
        edit = _value_edit(spec["op"], spec.get("args") or {})
        dtype = field_type(df.schema, parse_path(spec["path"]))
        if dtype is not None and spec["op"] in ("cast", "to_uuid", "to_decimal", "to_timestamp"):
            df = df.withColumn(f"_failed{n}", _failed(spec, edit, dtype))
            lost.append(f"_failed{n}")
        # Each transform is looked at on the rows as it finds them.
        df = apply_transform(df, spec)
    if not lost:
        return df.select(key, F.lit(None).cast(FAILURE).alias("f")).filter(F.lit(False)).select(key, "f.*")
    return df.select(key, F.explode(F.concat(*lost)).alias("f")).select(key, "f.*")


FAILURE = "struct<op:string,path:string,value:string>"


def _failed(spec: dict, edit: Edit, dtype: T.DataType) -> Column:
    bad = F.filter(_all(None, parse_path(spec["path"])), lambda v: v.isNotNull() & edit(v, dtype).isNull())
    return F.transform(
        F.coalesce(bad, F.array().cast(T.ArrayType(dtype))),
        lambda v: F.struct(F.lit(spec["op"]).alias("op"), F.lit(spec["path"]).alias("path"), v.cast("string").alias("value")),
    )
