"""Resolving names, places and histories to commune codes. Ambiguity gives null and is reported, never a guess."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioworks.functions import text as T
from folioworks.operators.places import commune_at_point
from folioworks.operators.shared import keep, numbered


def unique_alias(alias: DataFrame) -> DataFrame:
    """(dept, key, code) for aliases (dept, name, code) whose key stands for one code only."""
    keyed = alias.select("dept", T.key_spaced("name").alias("key"), "code").where("dept is not null and key <> '' and code is not null")
    return keyed.groupBy("dept", "key").agg(F.min("code").alias("code"), F.max("code").alias("top")).where("code = top").drop("top")


def distinct_names(rows: DataFrame, name: str = "name", dept: str = "dept") -> DataFrame:
    """(dept, name), each once: names are resolved once and joined back, so a frequent name costs no more than a rare one."""
    return rows.select(F.col(dept).alias("dept"), F.col(name).alias("name")).where(F.trim("name") != "").distinct()


def resolve_by_alias(names: DataFrame, alias: DataFrame) -> DataFrame:
    """names (dept, name) with `code` of their alias or null; an unknown department never matches."""
    keyed = names.withColumn("key", T.key_spaced("name"))
    return keyed.join(unique_alias(alias), ["dept", "key"], "left").select(*names.columns, "code")


def resolve_by_name(names: DataFrame, communes: DataFrame, key=T.key_compact) -> DataFrame:
    """names (dept, name) with `code` of the commune of that name in that department.

    Without a department: the most populous commune of the name. Two communes of one name in a department: null.
    Exact keys only; there is no fuzzy match.
    """
    c = communes.select(F.col("dept").alias("c_dept"), key("nom").alias("key"), "insee", "population").where("key <> ''")
    local = c.groupBy("c_dept", "key").agg(F.min("insee").alias("code"), F.max("insee").alias("top")).where("code = top").drop("top")
    anywhere = c.groupBy("key").agg(F.min_by("insee", F.struct(-F.col("population"), "insee")).alias("anywhere"))
    keyed = names.withColumn("key", key("name"))
    out = keyed.join(local, (keyed["dept"] == local["c_dept"]) & (keyed["key"] == local["key"]), "left").drop(local["key"]).join(anywhere, "key", "left")
    return out.select(*names.columns, F.when(F.col("dept").isNull(), F.col("anywhere")).otherwise(F.col("code")).alias("code"))


def resolve_multi_dept(names: DataFrame, communes: DataFrame, depts: list[str], key=T.key_compact) -> DataFrame:
    """names (name) over a portal's departments: `code` when all hits are one code, else null; `ambiguous` when there are several."""
    c = communes.where(F.col("dept").isin(depts)).select(key("nom").alias("key"), "insee").where("key <> ''")
    hits = c.groupBy("key").agg(F.countDistinct("insee").alias("n"), F.min("insee").alias("code"))
    out = names.withColumn("key", key("name")).join(hits, "key", "left")
    return out.select(*names.columns, F.when(F.col("n") == 1, F.col("code")).alias("code"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def resolve_cascade(rows: DataFrame, alias: DataFrame, communes: DataFrame, steps: list[tuple[str, Column]], dept: str = "dept") -> DataFrame:
    """rows with insee, method and resolved_name: the first step whose name resolves, alias before rubric test before name.

    steps: (method, Column of a raw name), in order.
    """
    # Each step's form is worked out where the rows are read; as a column it goes through the joins, which else would work it out for
    # their exchange, their sort and their comparison again.
    forms = [f"form{i}_" for i in range(len(steps))]
    formed = rows.withColumns({f: T.clean_commune_listed(name) for f, (_, name) in zip(forms, steps, strict=True)})
    each = formed.select(F.col(dept).alias("dept"), F.explode(F.array_distinct(F.array(*forms))).alias("name"))
    names = distinct_names(each)
    by_alias = resolve_by_alias(names, alias).withColumnRenamed("code", "by_alias")
    by_name = resolve_by_name(by_alias, communes, T.key_spaced)
    found = by_name.select(F.col("dept").alias("d_"), F.col("name").alias("n_"), F.coalesce("by_alias", F.when(~T.is_rubric_title("name"), F.col("code"))).alias("c_")).where("c_ is not null")
    found = keep(found, "cascade-names")  # a row for each resolved name, met once by each step
    out, taken = formed, []
    for i, (method, _) in enumerate(steps):
        f = found.select(*(F.col(c).alias(f"{c}{i}") for c in found.columns))
        out = out.join(f, F.col(dept).eqNullSafe(F.col(f"d_{i}")) & (F.col(forms[i]) == F.col(f"n_{i}")), "left")
        taken.append(F.when(F.col(f"c_{i}").isNotNull(), F.struct(F.col(f"c_{i}").alias("insee"), F.lit(method).alias("method"), F.col(f"n_{i}").alias("resolved_name"))))
    return out.select(*rows.columns, F.coalesce(*taken).alias("r")).select(*rows.columns, "r.insee", "r.method", "r.resolved_name")


def lookup(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """rows with columns of a dimension (name -> new name); unknown keys give null."""
    d = dim.select(F.col(dim_key).alias("k_"), *(F.col(c).alias(n) for c, n in columns.items())).dropDuplicates(["k_"])
    return rows.join(d, F.col(key) == F.col("k_"), "left").drop("k_")


def assign_insee_to_bbox(docs: DataFrame, communes: DataFrame) -> DataFrame:
    """docs with xmin, ymin, xmax, ymax get the `insee` of the commune that holds their centre."""
    centre = docs.drop("insee").withColumn("lon", (F.col("xmin") + F.col("xmax")) / 2).withColumn("lat", (F.col("ymin") + F.col("ymax")) / 2)
    return commune_at_point(centre, communes).drop("lon", "lat")


def first_communal_place(nodes: DataFrame, locations: DataFrame) -> DataFrame:
    """(id, label): a node's first place, in order, that is a commune. nodes: (id, location_ids), locations: (id, label)."""
    each = nodes.select("id", F.posexplode("location_ids").alias("pos", "loc"))
    loc = locations.select(F.col("id").alias("loc"), "label").where(~T.is_non_commune_place("label"))
    return each.join(loc, "loc").groupBy("id").agg(F.min_by("label", "pos").alias("label"))


def tree_commune_by_cote_order(cotes: DataFrame, tree: DataFrame, order: Column) -> DataFrame:
    """(cote, name): the i-th cote by `order` goes with the i-th commune of the tree (nom, rang). A fallback by position, for lists of one fund.

    Cotes of equal `order` go by their text, communes of equal `rang` by their name, so runs agree.
    """
    a = numbered(cotes.select("cote"), [order, F.col("cote")], "i")
    b = numbered(tree.select(F.col("nom").alias("name"), "rang"), [F.col("rang"), F.col("name")], "i")
    return a.join(b, "i", "left").select("cote", "name")


def compare_methods(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(outcome, n): agree, disagree, only_a, only_b, over keys that either method resolved."""
    x, y = (f.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias(n)) for f, n in ((a, "a"), (b, "b")))
    outcome = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") == F.col("b"), "agree").otherwise("disagree")
    return x.join(y, "k", "full").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def resolve_succession(movements: DataFrame, current: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(code, target): each former code's present commune; null when a link on the way is split, missing or a cycle.

    movements: (typecom_av, com_av, typecom_ap, com_ap); only moves between communes count. Pointer jumping: each
    round doubles the links already followed, so a chain of n links takes log2(n) rounds.
    """
    m = movements.where("typecom_av = 'COM' and typecom_ap = 'COM' and com_av <> com_ap and com_av <> '' and com_ap <> ''").select("com_av", "com_ap").distinct()
    next_ = m.groupBy("com_av").agg(F.count("*").alias("n"), F.min("com_ap").alias("com_ap"))
    now = current.select(F.col("code").alias("c_")).distinct()
    codes = m.select(F.col("com_av").alias("code")).union(m.select("com_ap")).distinct()
    p = codes.join(now, F.col("code") == F.col("c_"), "left").join(next_, F.col("code") == F.col("com_av"), "left")
    own = F.when(F.col("c_").isNotNull(), F.col("code")).when(F.col("n") == 1, F.col("com_ap"))
    p = keep(p.select("code", own.alias("to"), F.col("c_").isNotNull().alias("ends")), "succession")
    open_ = None
    for _ in range(most_rounds):
        # A pointer that reaches a present commune is done; others jump to where their target points.
        q = p.select(F.col("code").alias("q_"), F.col("to").alias("q_to"), F.col("ends").alias("q_ends"))
        j = p.join(q, F.col("to") == F.col("q_"), "left")
        done = F.col("ends") | F.col("to").isNull()
        jumped = j.select("code", F.when(done, F.col("to")).when(F.col("q_ends"), F.col("q_to")).otherwise(F.col("q_to")).alias("to"), (F.col("ends") | F.coalesce("q_ends", F.lit(False))).alias("ends"))
        p = keep(jumped, "succession")
        left = p.where("not ends and to is not null").count()
        if not left or left == open_:  # none left, or only cycles
            break
        open_ = left
    return p.select("code", F.when(F.col("ends"), F.col("to")).alias("target"))


def build_alias(history: DataFrame, movements: DataFrame, current: DataFrame, prefix: str = "") -> DataFrame:
    """(name, targets, outcome, code) per historic label: alias, ambiguous, lost or current.

    history: (typecom, com, libelle, nccenr); current: (code, nom).
    """
    h = history.where((F.col("typecom") == "COM") & F.startswith("com", F.lit(prefix)))
    labels = h.select("com", F.explode(F.array("libelle", "nccenr")).alias("name")).withColumn("name", T.strip("name")).where("name <> ''").distinct()
    target = resolve_succession(movements, current)
    own = current.select(F.col("code").alias("own_")).distinct()
    t = labels.join(target, F.col("com") == F.col("code"), "left").join(own, F.col("com") == F.col("own_"), "left")
    t = t.select("name", F.coalesce("own_", "target").alias("target"))
    g = t.groupBy("name").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    one = g.withColumn("code", F.when(F.size("targets") == 1, F.get("targets", F.lit(0))))
    named = one.join(current.select(F.col("code").alias("cur_"), F.col("nom").alias("cur_nom")), F.col("code") == F.col("cur_"), "left")
    outcome = F.when(F.size("targets") > 1, "ambiguous").when(F.size("targets") == 0, "lost").when(F.col("name") == F.col("cur_nom"), "current").otherwise("alias")
    return named.select("name", "targets", outcome.alias("outcome"), F.when(outcome == "alias", F.col("code")).alias("code"))


def merge_alias(existing: DataFrame, built: DataFrame) -> DataFrame:
    """(dept, name, code): existing, manual entries win."""
    a = existing.select("dept", "name", F.col("code").alias("old")).dropDuplicates(["dept", "name"])
    b = built.select("dept", "name", F.col("code").alias("new")).dropDuplicates(["dept", "name"])
    return a.join(b, ["dept", "name"], "full").select("dept", "name", F.coalesce("old", "new").alias("code"))


def resolution_summary(rows: DataFrame, name: str, insee: str) -> DataFrame:
    """One row: distinct names, resolved names, unresolved rows."""
    per = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.max(F.col(insee).isNotNull()).alias("ok"), F.count("*").alias("rows"))
    return per.agg(F.count("*").alias("names"), F.count_if("ok").alias("resolved"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("rows"))), F.lit(0)).alias("unresolved_rows"))


class WrongDepartment(ValueError):
    """Too many rows resolve outside the departments expected."""


def outside_share(rows: DataFrame, expected: list[str], insee: str = "insee") -> DataFrame:
    """One row: resolved rows, those outside the expected departments."""
    some = rows.where(F.col(insee).isNotNull())
    return some.agg(F.count("*").alias("resolved"), F.count_if(~T.department(insee).isin(expected)).alias("outside"))


def department_guard(rows: DataFrame, expected: list[str], most: float = 0.05, insee: str = "insee") -> DataFrame:
    """`rows` unchanged, or WrongDepartment: when nothing is resolved, or more than `most` of it lies outside."""
    _refuse(*outside_share(rows, expected, insee).first(), expected, most)
    return rows


def _refuse(n: int, outside: int, expected: list[str], most: float) -> None:
    if not n:
        raise WrongDepartment("no row is resolved")
    if outside / n > most:
        raise WrongDepartment(f"{outside} of {n} rows lie outside {expected}")


def write_guarded(rows: DataFrame, path: str, expected: list[str], most: float = 0.05, insee: str = "insee") -> tuple[int, int]:
    """Writes `rows` as Parquet to the new folder `path` under department_guard's rule, and gives (resolved rows, those outside).

    The figures come from the pass that writes: rows go to a folder beside `path`, which takes its name only if the guard
    holds and is deleted if not.
    """
    figures = Observation()
    outside = F.col(insee).isNotNull() & ~T.department(insee).isin(expected)
    seen = rows.observe(figures, F.count(insee).alias("n"), F.count_if(outside).alias("outside"))
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    jvm = rows.sparkSession.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = place(path).getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    try:
        seen.write.parquet(aside)
        n, out = figures.get["n"], figures.get["outside"]
        _refuse(n, out, expected, most)
        if system.exists(place(path)) or not system.rename(place(aside), place(path)):
            raise FileExistsError(path)
    finally:
        system.delete(place(aside), True)
    return n, out


def unresolved_report(rows: DataFrame, history: DataFrame | None = None, title: str = "commune_raw", insee: str = "insee") -> DataFrame:
    """(label, family, n) of rows without a code. D rubric title, A present name in brackets, C historic name, B plain name."""
    u = rows.where(F.col(insee).isNull()).groupBy(F.col(title).alias("label")).agg(F.count("*").alias("n"))
    historic = F.lit(False)
    if history is not None:
        h = history.select(T.key_spaced("name").alias("h_")).distinct()
        u = u.join(h, T.key_spaced("label") == F.col("h_"), "left")
        historic = F.col("h_").isNotNull()
    family = F.when(T.is_rubric_title("label"), "D").when(F.col("label").rlike(r"\("), "A").when(historic, "C").otherwise("B")
    return u.select("label", family.alias("family"), "n")


def replay_unresolved(rows: DataFrame, alias: DataFrame, communes: DataFrame, places: list[str], name: str = "commune_raw", dept: str = "dept_expected") -> DataFrame:
    """`rows` with `insee` filled where it was null and a richer reference resolves it; the others are untouched."""
    forms = {"reordered": T.reorder_article(name), "bracketed": T.clean_commune_paren(name, places), "slash": T.clean_commune_slash(name)}
    todo = keep(rows.where("insee is null").drop("insee").withColumns({f"{k}_": c for k, c in forms.items()}), "replay")  # each form is worked out once
    todo = resolve_cascade(todo, alias, communes, [(k, F.col(f"{k}_")) for k in forms], dept)
    return rows.where("insee is not null").unionByName(todo.select(*rows.columns))
