"""Schemas that drift between files: one table with the contract's fields, and every change of every file.

Records are exploded into (field, JSON type, value) once.  Each field of each file and event type gets a profile:
its types and a value sketch, the shares of its values that show a feature (exact value, shape, word, object key,
magnitude, length).  A contract field's reference sketch comes from all files that still use its name.  Between the fields a file lacks and
those it has beyond the contract, an optimal bipartite matching on sketch and name similarity finds the renames;
what stays unmatched was removed or added.

Sketches are tables of features and their shares, whole, and are compared by joins on the feature; what Python sees of a pair of
fields is a handful of sums for each class of features, and of a file and event type its pairs, whose number depends on field names only.
No rule changes with the number of records or values: their weight fades in and out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomspark.session import Scratch, salted_lookup

#: Least score of a rename, and the weight of names in it: usually, and where values say nothing.
LEAST_SCORE, NAME_WEIGHT, NAME_WEIGHT_FLAT = 0.45, 0.3, 0.6
#: Effective number of values up to which a field is one of few values, and number of records at which half their weight is lost.
FEW_VALUES, FEW_RECORDS = 16, 6
#: Weight of a class of features in the likeness of two sketches.
CLASS_WEIGHTS = {"type": 1.0, "shape": 2.0, "value": 1.0, "word": 1.5, "key": 2.0, "size": 1.5, "long": 0.5}

_TYPE = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "FLOAT": "number"}


def compare_key(c: Column) -> Column:
    """Adapters and event types compare without case and outer blanks, ``-`` and ``_`` being equal."""
    return F.replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit("-"), F.lit("_"))


def _json_type(value: str) -> Column:
    kind = F.expr(f"schema_of_variant({value})")
    known = F.create_map(*[F.lit(x) for pair in _TYPE.items() for x in pair])
    return F.coalesce(known[kind], F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.startswith("DECIMAL"), "number").otherwise("string"))


def explode_fields(records: DataFrame) -> DataFrame:
    """source_file_id, adapter_key, event_key, field, type, value (text) of every field of every record.

    A record that is no JSON object has no fields; the last of repeated keys holds.  Nulls keep type ``null``.
    """
    rows = records.select("source_file_id", compare_key(F.col("adapter")).alias("adapter_key"), compare_key(F.col("event_type")).alias("event_key"), F.from_json("record", "map<string,variant>").alias("m"))
    rows = rows.select("source_file_id", "adapter_key", "event_key", F.explode("m").alias("field", "v"))
    kind = F.when(F.col("v").isNull() | F.expr("is_variant_null(v)"), F.lit("null")).otherwise(_json_type("v"))
    return rows.select("source_file_id", "adapter_key", "event_key", "field", kind.alias("type"), F.when(kind != "null", F.expr("cast(v as string)")).alias("value"))


def value_features(kind: Column, value: Column) -> Column:
    """The features one value adds to its field's sketch."""
    hexed = F.regexp_replace(F.regexp_replace(value, r"(?i)\b[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "\u0001"), r"\b(?=[a-f]*[0-9])[0-9a-f]{6,}\b", "\u0002")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(hexed, r"\p{Lu}+", "A"), r"\p{L}+", "a"), r"\d+", "9")
    words = F.size(F.split(F.trim(value), r"\s+"))
    shape = F.when(words > 1, F.concat(F.lit("text"), F.floor(F.log2(words.cast("double"))))).otherwise(shape)
    magnitude = F.floor(F.log2(F.abs(F.coalesce(value.try_cast("double"), F.lit(0.0))) + 1.0))
    number = kind.isin("integer", "number")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}{2,})"), 1))
    return F.array_compact(
        F.flatten(
            F.array(
                F.array(F.concat(F.lit("type "), kind), F.when(kind != "number", F.concat(F.lit("value "), F.xxhash64(value).cast("string")))),
                F.array(F.when(number, F.concat(F.lit("size "), magnitude)), F.when(kind == "string", F.concat(F.lit("shape "), shape)), F.when(kind == "string", F.concat(F.lit("long "), F.floor(F.log2(F.length(value) + 1.0))))),
                F.when(kind == "object", F.transform(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), lambda k: F.concat(F.lit("key "), k))).otherwise(F.array().cast("array<string>")),
                F.when((kind == "array") | (words > 1), F.transform(tokens, lambda t: F.concat(F.lit("word "), t))).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def sketches(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, share (of the non-null values that show it), of (their number): one row per feature."""
    rows = fields.filter("type <> 'null'")
    counts = rows.select(*keys, F.explode(value_features(F.col("type"), F.col("value"))).alias("feature")).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"))
    return counts.join(totals, keys).select(*keys, "feature", (F.col("n") / F.col("of")).alias("share"), "of")


_CLASS_OF = "substring_index(feature, ' ', 1)"


def compared(pairs: DataFrame, own: DataFrame, reference: DataFrame, unit: list[str], ref: list[str]) -> DataFrame:
    """pairs with what their sketches have in common: own (class, mass, known, shared) and reference (class, mass, top, concentration, values), of and ref_of.

    ``own`` is sketched by unit and file_field, ``reference`` by ``ref``.  Null where a side has no values.
    """
    both = pairs.join(own.withColumnRenamed("share", "y"), [*unit, "file_field"]).join(reference.select(*ref, "feature", F.col("share").alias("x")), [*ref, "feature"], "left")
    kinds = both.groupBy(*unit, "contract_field", "file_field", "of", F.expr(_CLASS_OF).alias("class")).agg(F.sum("y").alias("mass"), F.sum(F.when(F.col("x").isNotNull(), F.col("y")).otherwise(0.0)).alias("known"), F.sum(F.when(F.col("x").isNotNull(), F.least("x", "y")).otherwise(0.0)).alias("shared"))
    mine = kinds.groupBy(*unit, "contract_field", "file_field", "of").agg(F.collect_list(F.struct("class", "mass", "known", "shared")).alias("own"))
    theirs = reference.groupBy(*ref, F.col("of").alias("ref_of"), F.expr(_CLASS_OF).alias("class")).agg(F.sum("share").alias("mass"), F.max("share").alias("top"), F.sum(F.col("share") * F.col("share")).alias("concentration"), F.count(F.lit(1)).alias("values"))
    theirs = theirs.groupBy(*ref, "ref_of").agg(F.collect_list(F.struct("class", "mass", "top", "concentration", "values")).alias("reference"))
    return pairs.join(mine, [*unit, "contract_field", "file_field"], "left").join(theirs, ref, "left")


def few_values(reference: dict, ref_of: float) -> float:
    """0 to 1: how much a field is one of few values that repeat, by the share of repeats and the effective number of values."""
    values = reference.get("value")
    if not values or not ref_of:
        return 0.0
    repeats = 1 - values["values"] / ref_of
    return max(0.0, min(1.0, (repeats - 0.5) / 0.25)) * min(1.0, FEW_VALUES * values["concentration"])


def sketch_similarity(reference: dict[str, dict], own: dict[str, dict], ref_of: float) -> float:
    """How well a field's sketch fits a reference sketch, 0 to 1, over the feature classes either shows.

    A class counts by the mean of the shares both have and the share of the field's features the reference knows at all: a file with two
    records can't show the reference's shares, but what it shows must be known there.  The more a field is one of few values, the more
    it matters whether the values are among them.
    """
    total = score = 0.0
    for kind, weight in CLASS_WEIGHTS.items():
        x, y = reference.get(kind), own.get(kind)
        if kind == "value":  # values that hardly repeat say little
            weight *= min(1.0, (x["top"] if x else 0.0) / 0.05) ** 4
        if x or y:
            total += weight
            shared = y["shared"] / max(x["mass"] if x else 0.0, y["mass"]) if y else 0.0
            known = y["known"] / y["mass"] if y else 0.0
            score += weight * (shared + known) / 2
    rest = score / total if total else 0.0
    values = own.get("value")
    if not values:
        return rest
    known, shared = values["known"] / values["mass"], values["shared"] / values["mass"]
    among = known if known >= 1 else (known + max(shared, known / 2)) / 2
    weight = 0.75 * few_values(reference, ref_of)
    return (1 - weight) * rest + weight * among


def name_similarity(a: str, b: str) -> float:
    """Share of common character pairs of two field names, case and separators aside (Dice); 0.9 where one of three characters or more lies in the other."""
    a, b = ("".join(ch for ch in x.lower() if ch.isalnum()) for x in (a, b))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) > 2 and (a in b or b in a):
        return 0.9
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def best_matching(score: list[list[float]]) -> list[tuple[int, int]]:
    """Row-column pairs of a matching with the greatest total score (Hungarian method with potentials)."""
    if not score or not score[0]:
        return []
    flip = len(score) > len(score[0])
    cost = [[-v for v in row] for row in (zip(*score) if flip else score)]
    n, m, inf = len(cost), len(cost[0]), float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j], row, delta, nxt = True, owner[j], inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    reduced = cost[row - 1][k - 1] - u[row] - v[k]
                    if reduced < least[k]:
                        least[k], way[k] = reduced, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[owner[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j], j = owner[way[j]], way[j]
    pairs = [(owner[k] - 1, k - 1) for k in range(1, m + 1) if owner[k]]
    return [(b, a) for a, b in pairs] if flip else pairs


def pair_score(contract_field: str, file_field: str, json_type: str, reference: dict[str, dict] | None, own: dict[str, dict] | None, ref_of: float, of: float) -> float:
    """The score of a rename: likeness of the sketches and of the names; names weigh more where values say little, least in a few records."""
    names = name_similarity(contract_field, file_field)
    if not reference or not own:
        return 0.6 * names
    flat = 1.0 if json_type == "boolean" else few_values(reference, ref_of) / (1 + (of / FEW_RECORDS) ** 2) if json_type == "integer" else 0.0
    weight = NAME_WEIGHT + (NAME_WEIGHT_FLAT - NAME_WEIGHT) * flat
    return (1 - weight) * sketch_similarity(reference, own, ref_of) + weight * names


@pandas_udf(ArrayType(StructType([StructField("contract_field", StringType()), StructField("file_field", StringType())])))
def _renames(pairs: pd.Series) -> pd.Series:
    """The matching of each file and event type, from its candidate pairs."""
    by_class = lambda sums: {s["class"]: s for s in sums} if sums is not None else None
    out = []
    for group in pairs:
        wanted, extra = sorted({p["contract_field"] for p in group}), sorted({p["file_field"] for p in group})
        score = [[0.0] * len(extra) for _ in wanted]
        for p in group:
            value = pair_score(p["contract_field"], p["file_field"], p["json_type"], by_class(p["reference"]), by_class(p["own"]), p["ref_of"] or 0, p["of"] or 0)
            score[wanted.index(p["contract_field"])][extra.index(p["file_field"])] = value if value >= LEAST_SCORE else 0.0
        out.append([(wanted[i], extra[j]) for i, j in best_matching(score) if score[i][j] >= LEAST_SCORE])
    return pd.Series(out, dtype=object)


class Drift:
    """The comparison of ``records`` with ``contract``: ``changes()`` and ``unified()``.

    records: source_file_id, adapter, event_type, record (JSON object text), line_no for ``unified``; contract: adapter,
    event_type, field, json_type.  Other columns are ignored.  Nulls in adapter or event_type make a group of their own
    that has no contract, whose fields are all ``added``.  Rows delivered twice change nothing but the shares.
    Empty tables give empty results.
    """

    unit = ["source_file_id", "adapter_key", "event_key"]

    def __init__(self, records: DataFrame, contract: DataFrame):
        self.records = records
        self.scratch = Scratch(records.sparkSession, "drift")
        self.contract = contract.select(
            F.coalesce(compare_key(F.col("adapter")), F.lit("")).alias("adapter_key"), F.coalesce(compare_key(F.col("event_type")), F.lit("")).alias("event_key"), F.col("event_type").alias("event_name"), F.col("field").alias("contract_field"), "json_type"
        ).dropDuplicates(["adapter_key", "event_key", "contract_field"])
        keyed = records.withColumns({"adapter": F.coalesce("adapter", F.lit("")), "event_type": F.coalesce("event_type", F.lit(""))})
        self.keyed = keyed
        self.fields = self.scratch.keep(explode_fields(keyed), "fields")  # read several times
        self._renamed: DataFrame | None = None

    def _profiles(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        units = self.keyed.select("source_file_id", compare_key(F.col("adapter")).alias("adapter_key"), compare_key(F.col("event_type")).alias("event_key")).distinct()
        types = self.fields.groupBy(*self.unit, "field").agg(F.collect_set(F.when(F.col("type") != "null", F.col("type"))).alias("types"))
        types = self.scratch.keep(types, "types")
        due = self.scratch.keep(units.join(self.contract, ["adapter_key", "event_key"]), "due")
        have = types.select(*self.unit, F.col("field").alias("contract_field"), "types")
        matched = self.scratch.keep(due.join(have, [*self.unit, "contract_field"], "left"), "matched")
        extra = types.withColumnRenamed("field", "file_field").join(due.withColumnRenamed("contract_field", "file_field").select(*self.unit, "file_field"), [*self.unit, "file_field"], "left_anti")
        return matched, matched.filter("types IS NULL").drop("types"), self.scratch.keep(extra, "extra")

    def _find(self) -> None:
        if self._renamed is not None:
            return
        self.matched, self.absent, self.extra = self._profiles()
        pairs = self.absent.join(self.extra.filter("size(types) > 0"), self.unit)
        pairs = pairs.filter(F.array_contains("types", F.col("json_type")) | ((F.col("json_type") == "number") & F.array_contains("types", "integer")))
        pairs = self.scratch.keep(pairs, "pairs")
        ref = ["adapter_key", "event_key", "contract_field"]
        new = self.fields.withColumnRenamed("field", "file_field").join(pairs.select(*self.unit, "file_field").distinct(), [*self.unit, "file_field"], "left_semi")
        wanted = pairs.select(*ref, F.col("json_type").alias("type")).distinct()
        held = self.fields.withColumnRenamed("field", "contract_field").join(wanted, [*ref, "type"], "left_semi")
        scored = compared(pairs.select(*self.unit, "contract_field", "file_field", "json_type"), sketches(new, [*self.unit, "file_field"]), sketches(held, ref), self.unit, ref)
        group = scored.groupBy(*self.unit).agg(F.collect_list(F.struct("contract_field", "file_field", "json_type", "of", "ref_of", "own", "reference")).alias("pairs"))
        self._renamed = self.scratch.keep(group.select(*self.unit, F.explode(_renames("pairs")).alias("r")).select(*self.unit, "r.*"), "renamed")

    def changes(self) -> DataFrame:
        """source_file_id, event_type, change, contract_field, file_field: one row per change."""
        self._find()
        names = self.contract.groupBy("adapter_key", "event_key").agg(F.min("event_name").alias("event_name"))
        none = F.lit("")
        fits = F.array_contains("types", F.col("json_type")) | ((F.col("json_type") == "number") & F.array_contains("types", "integer"))
        renamed = self._renamed.withColumn("change", F.lit("renamed"))
        removed = self.absent.join(self._renamed, [*self.unit, "contract_field"], "left_anti").select(*self.unit, "contract_field", none.alias("file_field"), F.lit("removed").alias("change"))
        added = self.extra.join(self._renamed, [*self.unit, "file_field"], "left_anti").select(*self.unit, none.alias("contract_field"), "file_field", F.lit("added").alias("change"))
        retyped = self.matched.filter((F.size("types") > 0) & ~fits).select(*self.unit, "contract_field", F.col("contract_field").alias("file_field"), F.lit("retyped").alias("change"))
        every = renamed.unionByName(removed).unionByName(added).unionByName(retyped)
        return every.join(names, ["adapter_key", "event_key"], "left").select("source_file_id", F.coalesce("event_name", "event_key").alias("event_type"), "change", "contract_field", "file_field")

    def unified(self, fields: list[str]) -> DataFrame:
        """Every record once, with ``fields`` (names of the contract) as columns f_<field>, renamed fields under their contract name.

        A column has the type the contract gives the field: bigint, double or boolean where every event type agrees, else text (arrays and objects as
        JSON).  A value of another type is cast where it reads as one of that type (``"12"`` as 12), else null; its text is in ``recast``, by field.
        """
        self._find()
        moved = self._renamed.groupBy(*self.unit).agg(F.map_from_entries(F.collect_list(F.struct("contract_field", "file_field"))).alias("moved"))
        moved = moved.withColumn("unit", F.concat_ws("\u0001", *self.unit)).select("unit", "moved")
        rows = self.keyed.dropDuplicates(["source_file_id", "line_no"]).select("source_file_id", "line_no", compare_key(F.col("adapter")).alias("adapter_key"), compare_key(F.col("event_type")).alias("event_key"), F.from_json("record", "map<string,variant>").alias("m"))
        rows = salted_lookup(rows.withColumn("unit", F.concat_ws("\u0001", *self.unit)), moved, "unit", "line_no")
        kinds = {r["contract_field"]: r["kinds"] for r in self.contract.groupBy("contract_field").agg(F.collect_set("json_type").alias("kinds")).collect()}  # as many rows as the contract has fields
        sql = {"integer": "bigint", "number": "double", "boolean": "boolean"}
        text = lambda f: F.coalesce(F.try_element_at("m", F.lit(f)).cast("string"), F.try_element_at("m", F.try_element_at("moved", F.lit(f))).cast("string"))
        rows = rows.select("source_file_id", "line_no", F.col("adapter_key").alias("adapter"), F.col("event_key").alias("event_type"), *[text(f).alias(f"f_{f}") for f in fields])
        typed = {f: sql[kinds[f][0]] for f in fields if len(kinds.get(f, [])) == 1 and kinds[f][0] in sql}
        column = lambda f: F.col(f"`f_{f.replace('`', '``')}`")
        lost = [F.when(column(f).isNotNull() & column(f).try_cast(kind).isNull(), F.struct(F.lit(f).alias("field"), column(f).alias("text"))) for f, kind in typed.items()]
        recast = F.map_from_entries(F.array_compact(F.array(*lost))) if lost else F.create_map().cast("map<string,string>")
        return rows.select("source_file_id", "line_no", "adapter", "event_type", *[(column(f).try_cast(typed[f]) if f in typed else column(f)).alias(f"f_{f}") for f in fields], recast.alias("recast"))
