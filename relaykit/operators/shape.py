"""Documents to relational tables: decide the tables from inferred labels, then cut them out of the documents.

``plan_tables`` works on the merged schema (one entry per path) and a config; ``shape_documents`` turns the
plan into one lazy DataFrame per table.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaykit.functions import naming, sqltypes, variants

# Key column type of each id strategy.
ID_TYPES = {"rowid": "INT8", "uuid": "UUID", "use_objectid": "STRING(24)", "natural": "STRING"}


@dataclass
class TableColumn:
    name: str
    path: str | None  # below the row of the table; None for keys and indexes
    sql_type: str
    label: str = "string"
    nullable: bool = True
    default: str | None = None
    generated: str | None = None
    role: str = "field"  # field | id | parent | index | id_ts | legacy | lookup


@dataclass
class ForeignKey:
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "CASCADE"


@dataclass
class Table:
    name: str
    kind: str  # base | object | array | junction
    path: str = ""
    columns: list[TableColumn] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)

    def add(self, column: TableColumn) -> None:
        """Appends a column. A name that another path has taken gets the next free number."""
        if any(c.name == column.name and c.path == column.path and c.role == column.role for c in self.columns):
            return
        *_, column.name = naming.unique_names([*[c.name for c in self.columns], column.name])
        self.columns.append(column)


@dataclass
class Lookup:
    """A reference to another collection: ``legacy`` holds the source id, ``column`` the resolved key."""

    table: str
    legacy: str
    column: str
    parent: str
    parent_legacy: str
    parent_id: str


@dataclass
class Mapping:
    tables: list[Table]
    lookups: list[Lookup] = field(default_factory=list)
    id_strategy: str = "use_objectid"

    @property
    def base(self) -> Table:
        return self.tables[0]

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)


@dataclass
class _Node:
    path: str
    label: str | None = None
    fields: dict[str, "_Node"] = field(default_factory=dict)
    element: "_Node | None" = None


def _tree(labels: dict[str, str]) -> _Node:
    root = _Node("", "object")
    for path, label in sorted(labels.items()):
        node = root
        for step in re.findall(r"\[\]|[^.\[\]]+", path):
            if step == "[]":
                node.element = node.element or _Node(node.path + "[]")
                node = node.element
            else:
                full = f"{node.path}.{step}" if node.path else step
                node = node.fields.setdefault(step, _Node(full))
        node.label = label
    return root


class _Planner:
    def __init__(self, collection: str, config: dict):
        self.config = config
        defaults = config.get("tableDefaults", {})
        ids, arrays, columns = (defaults.get(k, {}) for k in ("id", "arrays", "columnDefaults"))
        self.case = defaults.get("nameStyle", "snake_case")
        self.limit = defaults.get("identifierMaxLen", 63)
        self.strategy = config.get("defaultStrategy", "columnize")
        self.array_strategy = config.get("arrayStrategy", "child_table")
        self.flatten_depth = config.get("flattenDepth", 1)
        self.id_strategy = ids.get("idStrategy", "use_objectid")
        self.preserve = ids.get("preserveSourceId", False)
        self.legacy = ids.get("preserveAs", "legacy_id")
        self.legacy_unique = ids.get("uniqueIndex", True)
        self.child_key = arrays.get("childPkDefault", "synthetic")
        self.index = arrays.get("arrayIndexColumnName", "elem_idx")
        self.on_delete = arrays.get("fkOnDelete", "CASCADE")
        self.type_options = dict(
            overrides=config.get("typeMap"),
            max_varchar=columns.get("maxVarchar", 1024),
            decimal_default=columns.get("decimalDefault", "DECIMAL(38,9)"),
            time_default=columns.get("timeTzDefault", "TIMESTAMPTZ"),
        )
        self.table_overrides = {o["path"]: o for o in config.get("tableOverrides", [])}
        self.column_overrides = {o["path"]: o for o in config.get("columnOverrides", [])}
        self.ignored = set(config.get("ignorePaths", [])) | {
            path
            for overrides in (self.table_overrides, self.column_overrides)
            for path, o in overrides.items()
            if o.get("action") == "ignore"
        }
        self.id_type = ID_TYPES[self.id_strategy]
        own = self.table_overrides.get(collection, {})
        self.references = {r["childColumns"]: r for r in _as_list(own.get("fk"))}
        self.mapping = Mapping([Table(own.get("targetTable") or self.name(collection), "base")], id_strategy=self.id_strategy)
        self.families = own.get("columnFamilies", [])

    def name(self, path: str) -> str:
        return naming.column_name(path, self.case, self.limit)

    def skip(self, path: str) -> bool:
        return path in self.ignored

    def column(self, node: _Node, below: str = "", name: str | None = None, sql_type: str | None = None) -> TableColumn:
        """Column for a node, with its override; ``below`` is the path of the table's row."""
        o = self.column_overrides.get(node.path, {})
        label = "object" if node.fields else node.label or "string"
        path = node.path[len(below):].lstrip(".")
        sql = o.get("type") or sql_type or sqltypes.label_type(label, **self.type_options)
        return TableColumn(
            self.name(o.get("name") or name or node.path), path, sql, label,
            o.get("nullable", True), o.get("default"), o.get("generated", {}).get("expr"),
        )

    def plan(self, root: _Node) -> Mapping:
        base = self.mapping.base
        key = self.name("id")
        base.key = [key]
        base.add(TableColumn(key, None, self.id_type, "objectId", nullable=False, role="id"))
        stamp = self.config.get("objectId", {}).get("derive", {})
        if stamp.get("timestamp") and self.id_strategy == "use_objectid":
            sql = self.type_options["time_default"]
            base.add(TableColumn(self.name(stamp.get("columnName", "id_ts")), None, sql, "date", role="id_ts"))
        if self.preserve and self.id_strategy != "use_objectid":
            legacy = TableColumn(self.name(self.legacy), None, "STRING(24)", "objectId", role="legacy")
            base.add(legacy)
            if self.legacy_unique:
                base.unique.append([legacy.name])
        for name, node in root.fields.items():
            if name not in ("_id", "id") and not self.skip(node.path):
                self.place(node, base, "", 1)
        explicit = self.config.get("tableDefaults", {}).get("primaryKey", {}).get("columns")
        if explicit:
            base.key = [self.name(c) for c in explicit]
        for table, families in [(base, self.families)] + [
            (t, self.table_overrides.get(t.path, {}).get("columnFamilies", [])) for t in self.mapping.tables[1:]
        ]:
            names = {c.name for c in table.columns} - set(table.key)
            for family in families:
                cols = [c if c in names else self.name(c) for c in family["columns"]]
                table.families[self.name(family["name"])] = list(dict.fromkeys(c for c in cols if c in names))
        return self.mapping

    def place(self, node: _Node, table: Table, below: str, depth: int) -> None:
        if node.element is not None and (node.fields or node.label not in (None, "array")):
            # An array in some documents, something else in others: kept whole, so nothing is lost.
            table.add(self.column(node, below, sql_type="JSON"))
        elif node.element is not None:
            self.place_array(node, table, below)
        elif node.fields and node.label not in (None, "object"):
            table.add(self.column(node, below, sql_type="JSON"))
        elif node.fields:
            self.place_object(node, table, below, depth)
        elif node.path in self.references and table.kind == "base":
            self.place_reference(node, table)
        else:
            table.add(self.column(node, below))

    def place_object(self, node: _Node, table: Table, below: str, depth: int) -> None:
        mode = self.table_overrides.get(node.path, {}).get("mode") or self.strategy
        if mode in ("normalize", "child_table"):
            self.normalize(node, table)
        elif mode == "jsonb" or depth > self.flatten_depth:
            table.add(self.column(node, below, sql_type="JSON"))
        else:
            for child in node.fields.values():
                if not self.skip(child.path):
                    self.place(child, table, below, depth + 1)

    def normalize(self, node: _Node, parent: Table) -> None:
        """One row per document that has the object; its arrays hang off this table."""
        o = self.table_overrides.get(node.path, {})
        key = self.name("id")
        table = Table(self.name(o.get("tableName") or node.path), "object", node.path)
        self.mapping.tables.append(table)
        reverse = next(iter(_as_list(o.get("fk"))), {}).get("reverseSpec") if o.get("fk") else None
        if reverse is None:
            table.key = [key]
            table.add(TableColumn(key, None, self.id_type, "objectId", nullable=False, role="id"))
            table.foreign_keys.append(ForeignKey([key], self.mapping.base.name, [key], self.on_delete))
        else:
            own = node.fields[reverse.get("childPkPath", "id")]
            own_key = self.column(own, node.path, name=own.path.rsplit(".", 1)[-1])
            own_key.nullable = False
            table.kind, table.key = "shared", [own_key.name]
            table.add(own_key)
            link = self.column(own, "", name=reverse.get("baseColumnName") or f"{node.path}_id")
            link.nullable = reverse.get("nullable", True)
            parent.add(link)
            parent.unique.append([link.name])
            parent.foreign_keys.append(
                ForeignKey([link.name], table.name, [own_key.name], reverse.get("onDelete", self.on_delete))
            )
        for child in node.fields.values():
            if self.skip(child.path) or (reverse is not None and child is own):
                continue
            if child.element is not None:
                self.place_array(child, table, node.path)
            else:
                table.add(self.column(child, node.path, sql_type="JSON" if child.fields else None))

    def place_reference(self, node: _Node, table: Table) -> None:
        """Field that names a document of another collection: a key column, and the source id beside it."""
        spec = self.references[node.path]
        parent, link = self.name(spec.get("parentTable") or node.path), self.name(f"{node.path}_id")
        legacy = link
        if self.id_strategy != "use_objectid":
            legacy = self.name(f"{node.path}_{self.legacy}")
            table.add(TableColumn(legacy, node.path, "STRING(24)", "objectId"))
            table.add(TableColumn(link, None, self.id_type, role="lookup"))
            parent_id = self.name("id")
            self.mapping.lookups.append(Lookup(table.name, legacy, link, parent, self.name(self.legacy), parent_id))
        else:
            table.add(TableColumn(link, node.path, self.id_type, "objectId"))
        table.foreign_keys.append(ForeignKey([link], parent, [self.name("id")], spec.get("onDelete", self.on_delete)))

    def place_array(self, node: _Node, owner: Table, below: str) -> None:
        element = node.element
        if self.skip(element.path):
            return
        o = self.table_overrides.get(element.path) or self.table_overrides.get(node.path) or {}
        mode = o.get("mode") or o.get("strategy") or self.array_strategy
        leaf = node.path.rsplit(".", 1)[-1]
        if mode == "jsonb":
            owner.add(self.column(node, below, name=leaf, sql_type="JSON"))
            return
        table = Table(
            o.get("targetTable") or self.name(node.path), "junction" if mode == "junction_table" else "array", element.path
        )
        self.mapping.tables.append(table)
        parent = owner if owner.kind == "object" else self.mapping.base
        link = self.name(f"{parent.name}_id")
        table.add(TableColumn(link, None, self.id_type, "objectId", nullable=False, role="parent"))
        depth = element.path.count("[]")
        positions = [self.name(self.index if i == 0 else f"{self.index}_{i + 1}") for i in range(depth)]
        composite = [link, *positions]
        synthetic = self.child_key == "synthetic" and self.id_strategy in ("rowid", "uuid")
        table.key = o.get("pk") or ([self.name("id")] if synthetic else composite)
        for position in positions:
            table.add(TableColumn(position, None, "INT4", "int32", nullable=False, role="index"))
        if synthetic and table.key == [self.name("id")]:
            table.add(TableColumn(self.name("id"), None, self.id_type, nullable=False, role="id"))
        references = [r for r in _as_list(o.get("fk")) if r.get("childColumns") in (element.path, node.path)]
        self.element_columns(element, element, table, refer=bool(references))
        table.foreign_keys.append(ForeignKey([link], parent.name, [self.name("id")], self.on_delete))
        for spec in references:
            self.element_reference(element, table, spec)

    def element_columns(self, element: _Node, node: _Node, table: Table, refer: bool) -> None:
        if not element.fields:
            if not (refer and table.kind == "junction"):
                table.add(self.column(element, element.path, name="value"))
            return
        for child in node.fields.values():
            if self.skip(child.path):
                continue
            if child.element is not None:
                self.place_array(child, table, element.path)
            elif child.fields:
                self.element_columns(element, child, table, refer)
            else:
                table.add(self.column(child, element.path, name=child.path[len(element.path) + 1:]))

    def element_reference(self, element: _Node, table: Table, spec: dict) -> None:
        stem = self.column_overrides.get(element.path, {}).get("name") or "value"
        link, parent = self.name(f"{stem}_id"), self.name(spec.get("parentTable") or stem)
        if self.id_strategy == "use_objectid":
            table.add(TableColumn(link, "", self.id_type, "objectId"))
        else:
            legacy = self.name(f"{stem}_{self.legacy}")
            table.add(TableColumn(legacy, "", "STRING(24)", "objectId"))
            table.add(TableColumn(link, None, self.id_type, role="lookup"))
            self.mapping.lookups.append(Lookup(table.name, legacy, link, parent, self.name(self.legacy), self.name("id")))
        table.foreign_keys.append(ForeignKey([link], parent, [self.name("id")], spec.get("onDelete", "CASCADE")))


def _as_list(value) -> list[dict]:
    return [value] if isinstance(value, dict) else list(value or [])


def plan_tables(labels: dict[str, str], collection: str, config: dict | None = None) -> Mapping:
    """Base, child, junction and shared tables for a collection, from ``{path: label}`` and a config."""
    return _Planner(collection, config or {}).plan(_tree(labels))


# ---- values -------------------------------------------------------------------------------------------


def key_value(source_id: Column, doc: Column, strategy: str) -> Column:
    """Row key of a document. Keys that a database would draw are hashes of the source id, so reruns agree."""
    if strategy == "rowid":
        return F.xxhash64(source_id)
    if strategy == "uuid":
        return uuid_of(source_id)
    if strategy == "natural":
        return variants.get(doc, ["id"], "string")
    return source_id


def uuid_of(text: Column) -> Column:
    return F.regexp_replace(
        F.substring(F.sha2(text, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def object_id_time(source_id: Column) -> Column:
    """Creation time in the first 8 hex digits of an object id."""
    return F.timestamp_seconds(F.conv(F.substring(source_id, 1, 8), 16, 10).cast("bigint"))


def typed_value(value: Column, names: list[str], label: str, sql_type: str) -> Column:
    """Value at a path in the Spark type of ``sql_type``; null where it cannot be converted."""
    target = sqltypes.spark_type(sql_type)
    if sql_type == "JSON":
        return variants.json_text(value, names)
    text = source_text(value, names, label)
    if target in ("timestamp", "timestamp_ntz"):
        millis = variants.get(value, [*names, "$date", "$numberLong"], "bigint")
        stamp = F.coalesce(F.timestamp_millis(millis), text.try_cast("timestamp"))
        return stamp if target == "timestamp" else stamp.cast("timestamp_ntz")
    return text if target == "string" else text.try_cast(target)


def source_text(value: Column, names: list[str], label: str) -> Column:
    """Plain text of a scalar, read through the wrapper that its label may use."""
    keys = [key for key, wrapped in variants.WRAPPERS.items() if wrapped == label and key != "$timestamp"]
    if label == "int64":
        keys.append("$numberInt")
    if label in ("double", "decimal"):
        keys = ["$numberDecimal", "$numberDouble", "$numberLong", "$numberInt"]
    if label == "int32":
        keys.append("$timestamp")
    read = [
        variants.get(value, [*names, key, "t"] if key == "$timestamp" else [*names, key], "string") for key in keys
    ]
    return F.coalesce(*read, variants.get(value, names, "string"))


def _steps(path: str) -> list[str]:
    return [s for s in path.split(".") if s]


def _rows(docs: DataFrame, table: Table, id_col: str, doc: str) -> tuple[DataFrame, list[Column]]:
    """Documents opened to the rows of a table, as columns ``_row`` and one position per array level."""
    rows = docs.select(F.col(id_col).alias("_source"), F.col(doc).alias("_doc"), F.col(doc).alias("_row"))
    if table.kind in ("base", "object", "shared"):
        if table.path:
            # Not by a filter: Spark would move it below the documents, which would be built once for each of its tests.
            found = F.filter(F.array(variants.get(F.col("_doc"), _steps(table.path), "variant")), lambda row: row.isNotNull() & ~F.is_variant_null(row))
            rows = rows.select("_source", "_doc", F.explode(found).alias("_row"))
        return rows, []
    positions = []
    for level, piece in enumerate(table.path.split("[]")[:-1]):
        at = f"_at{level}"
        kept = ["_source", "_doc", *positions]
        rows = rows.select(
            *kept, F.posexplode(variants.get(F.col("_row"), _steps(piece), "array<variant>")).alias(at, "_row")
        )
        positions.append(at)
    return rows, [F.col(p) for p in positions]


def table_rows(docs: DataFrame, mapping: Mapping, table: Table, id_col: str = "_id", doc: str = "doc", every: bool = False) -> DataFrame:
    """Rows of one planned table; a shared one has one row a key, or with ``every`` all that documents describe."""
    rows, positions = _rows(docs, table, id_col, doc)
    parent_id = key_value(F.col("_source"), F.col("_doc"), mapping.id_strategy)
    upcoming = iter(positions)
    out: list[Column] = []
    for c in table.columns:
        if c.role == "index":
            value = next(upcoming)
        elif c.role == "parent" or (c.role == "id" and not positions):
            value = parent_id
        elif c.role == "id":
            seed = F.concat_ws("/", F.col("_source"), F.lit(table.path), *[p.cast("string") for p in positions])
            value = F.xxhash64(seed) if mapping.id_strategy == "rowid" else uuid_of(seed)
        elif c.role == "id_ts":
            value = object_id_time(F.col("_source"))
            value = value if c.sql_type == "TIMESTAMPTZ" else value.cast("timestamp_ntz")
        elif c.role == "legacy":
            value = F.col("_source")
        elif c.role == "lookup":
            value = F.lit(None).cast(sqltypes.spark_type(c.sql_type))
        else:
            value = typed_value(F.col("_row"), _steps(c.path), c.label, c.sql_type)
            if c.default is not None:
                value = F.coalesce(value, F.expr(c.default).cast(sqltypes.spark_type(c.sql_type)))
        out.append(value.alias(c.name))
    shaped = rows.select(*out)
    for c in table.columns:
        if c.generated:
            shaped = shaped.withColumn(c.name, F.expr(c.generated).cast(sqltypes.spark_type(c.sql_type)))
    return first_by_key(shaped, table.key) if table.kind == "shared" and not every else shaped


def first_by_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the smallest by all columns in order, so reruns agree. ``shared_conflicts`` lists the others."""
    best = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.min(F.struct(*df.columns)).alias("row"))
    return best.select("row.*")


def shared_conflicts(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a shared table that documents describe differently, with the number of descriptions.

    ``df``: every row of the table (``table_rows`` with ``every``).
    """
    return df.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def shape_documents(docs: DataFrame, mapping: Mapping, id_col: str = "_id", doc: str = "doc") -> dict[str, DataFrame]:
    """All planned tables by name."""
    return {t.name: table_rows(docs, mapping, t, id_col, doc) for t in mapping.tables}


def payload_rows(docs: DataFrame, extract: dict[str, tuple[str, str]], id_col: str = "_id", doc: str = "doc") -> DataFrame:
    """Whole document as JSON with a few extracted columns: ``{column: (path, sql_type)}``."""
    cols = [
        typed_value(F.col(doc), _steps(path), "string" if sql.startswith("STRING") else _label_of(sql), sql).alias(name)
        for name, (path, sql) in extract.items()
    ]
    return docs.select(F.col(id_col).alias("id"), *cols, F.to_json(F.col(doc)).alias("payload"))


def _label_of(sql: str) -> str:
    return next((label for label, t in sqltypes.LABEL_TYPES.items() if t.split("(")[0] == sql.split("(")[0]), "string")


def conversion_failures(docs: DataFrame, mapping: Mapping, table: Table, id_col: str = "_id", doc: str = "doc") -> DataFrame:
    """Values present in the source that do not fit their column, too long texts among them: ``[source, column, value]``."""
    rows, _ = _rows(docs, table, id_col, doc)
    checks = []
    for c in table.columns:
        if c.role != "field" or c.path is None or c.sql_type == "JSON":
            continue
        steps = _steps(c.path)
        value = typed_value(F.col("_row"), steps, c.label, c.sql_type)
        length = re.fullmatch(r"STRING\((\d+)\)", c.sql_type)
        bad = value.isNull() | (F.length(value) > int(length[1])) if length else value.isNull()
        lost = variants.json_text(F.col("_row"), steps).isNotNull() & bad
        checks.append(
            F.when(lost, F.struct(F.lit(c.name).alias("column"), variants.json_text(F.col("_row"), steps).alias("value")))
        )
    return rows.select(
        F.col("_source").alias("source"), F.explode(F.array_compact(F.array(*checks))).alias("f")
    ).select("source", "f.column", "f.value")


def resolve_references(
    child: DataFrame, parent: DataFrame, legacy: str, parent_legacy: str, parent_id: str, column: str
) -> DataFrame:
    """Fills ``column`` of the child with the key of the parent whose legacy id it names; null is an orphan.

    The parent is reduced to its two id columns, so Spark broadcasts it when that is small and shuffles otherwise.
    Of several parents with one legacy id the smallest key counts, so no child row is multiplied.
    """
    ids = parent.groupBy(F.col(parent_legacy).alias(legacy)).agg(F.min(parent_id).alias("_resolved"))
    joined = child.join(ids, legacy, "left")
    return joined.withColumn(column, F.col("_resolved")).select(*child.columns, *([] if column in child.columns else [column]))


def junction_rows(child: DataFrame, parent: DataFrame, link: str, reference: str, parent_key: str) -> DataFrame:
    """Distinct (owner, target) pairs of a junction whose target exists."""
    pairs = child.select(link, reference).filter(F.col(reference).isNotNull()).distinct()
    targets = parent.select(F.col(parent_key).alias(reference))
    return pairs.join(targets, reference, "left_semi").select(link, reference)


def vertical_split(df: DataFrame, key: list[str], families: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One narrow table per column family, each with the key; columns in no family go to ``rest``."""
    named = {c for cols in families.values() for c in cols}
    rest = [c for c in df.columns if c not in named and c not in key]
    groups = {**families, **({"rest": rest} if rest else {})}
    return {name: df.select(*key, *cols) for name, cols in groups.items()}


def save_families(df: DataFrame, key: list[str], families: dict[str, list[str]], name: str, folder: str, buckets: int = 64) -> dict[str, str]:
    """One stored table per column family, all cut into the same buckets of the key and sorted; returns their names.

    Families are read alone, or joined by ``join_families`` without moving a row. ``name`` begins the tables' names,
    their files are under ``folder``. ``buckets`` should let one bucket fit into a task.
    """
    saved = {}
    dealt = df.repartition(buckets, *key)
    for family, part in vertical_split(dealt, key, families).items():
        saved[family] = f"{name}_{family}"
        part.write.bucketBy(buckets, *key).sortBy(*key).option("path", f"{folder}/{family}").mode("overwrite").saveAsTable(saved[family])
    return saved


def join_families(spark: SparkSession, saved: dict[str, str], key: list[str]) -> DataFrame:
    """The rows of all families, joined bucket by bucket."""
    parts = [spark.table(table) for table in saved.values()]
    return reduce(lambda a, b: a.join(b.hint("merge"), key), parts)


def conversion_summary(tables: dict[str, DataFrame], mapping: Mapping, config: dict) -> DataFrame:
    """Rows and columns per table, with the config key; one counting job over all tables."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            F.lit(mapping.table(name).kind).alias("kind"),
            F.lit(len(df.columns)).alias("n_columns"),
            "n_rows",
            F.lit(digest).alias("config_key"),
        )
        for name, df in tables.items()
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return summary
