"""Question templates times entities.

A template's tags choose one rule, by priority: the first whose tags are a subset of the template's (strict), which is
why a rule for one tag hides those for more; or the most specific one (strict=False). Each rule is one projection of an
entity table to (values: map of tag to value, code); replacing tags is a fold over the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small
from . import dedup

# Tags that templates may hold, and the rules in their order of priority.
TAGS_V1 = ("Class", "Function", "Method", "Variable", "Attribute", "Parameter", "Module", "Logic")
TAGS_V2 = ("Module", "Class", "Function", "Method", "Parameter", "Attribute")
RULES_V1 = (("Class",), ("Method",), ("Class", "Method"), ("Attribute",), ("Class", "Attribute"), ("Module",), ("Variable",), ("Function",), ("Term",), ("Context", "Variable"), ("File_Name",))
RULES_V2 = (("Module",), ("Module", "Class"), ("Module", "Function"), ("Module", "Class", "Method"), ("Class",), ("Function",), ("Class", "Function"), ("Class", "Method"), ("Method",), ("Attribute",), ("Class", "Attribute"), ("Function", "Parameter"))


def tags(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"<([^>]+)>"), F.lit(1))


def admitted(templates: DataFrame, valid: tuple[str, ...] = TAGS_V1, template: str = "template") -> DataFrame:
    """Templates all of whose tags are valid, with `tags`."""
    rows = templates.withColumn("tags", tags(F.col(template)))
    return rows.where(F.forall("tags", lambda t: t.isin(*valid)))


def dispatched(templates: DataFrame, rules: tuple[tuple[str, ...], ...] = RULES_V1, strict: bool = True) -> DataFrame:
    """`rule` (its tags joined by +) of each admitted template; templates that no rule fits go."""
    table = F.array(*[F.struct(F.lit("+".join(r)).alias("rule"), F.array(*map(F.lit, r)).alias("needs"), F.lit(i).alias("priority")) for i, r in enumerate(rules)])
    fits = F.filter(table, lambda r: F.size(F.array_except(r["needs"], F.col("tags"))) == 0)
    if not strict:
        fits = F.transform(fits, lambda r: F.struct((-F.size(r["needs"])).alias("n"), r["priority"].alias("priority"), r["rule"].alias("rule")))
        return templates.withColumn("rule", F.get(F.array_sort(fits), F.lit(0))["rule"]).where("rule is not null")
    return templates.withColumn("rule", F.get(fits, F.lit(0))["rule"]).where("rule is not null")


def filled(template: Column, values: Column) -> Column:
    """The template with <Tag> replaced by its value, tag by tag."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"]))


def _entity(rows: DataFrame, rule: str, code: str = "code", **values: str | Column) -> DataFrame:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.col(v))]
    return rows.select(F.lit(rule).alias("rule"), F.create_map(*pairs).alias("values"), F.array(F.col(code)).alias("codes"))


def entities(classes: DataFrame, functions: DataFrame, attributes: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """Every rule's (rule, values, codes), as one table.

    Methods bring their class's value, attributes theirs; a module's questions come once for each of its classes and
    once for each method or function. Term stands for all of classes, functions, methods and modules, each by its own tag,
    so that the tag Term itself stays in the question."""
    c = classes.where("code is not null")
    f = functions.where("not is_method")
    m = functions.where("is_method")
    owned = m.join(classes.select(F.col("name").alias("class_name"), F.col("code").alias("class_code")), "class_name")
    a = attributes.join(classes.select(F.col("name").alias("class_name"), F.col("code").alias("code")), "class_name")
    per = functions.select("name", "code", F.explode("parameters").alias("parameter"))
    out = [
        _entity(c, "Class", Class="name"),
        _entity(f, "Function", Function="name"),
        owned.select(F.lit("Method").alias("rule"), F.create_map(F.lit("Method"), "name", F.lit("Class"), "class_name").alias("values"), F.array("code", "class_code").alias("codes")),
        owned.select(F.lit("Class+Method").alias("rule"), F.create_map(F.lit("Class"), "class_name", F.lit("Method"), "name").alias("values"), F.array("class_code", "code").alias("codes")),
        _entity(a, "Attribute", Class="class_name", Attribute="name"),
        _entity(a, "Class+Attribute", Class="class_name", Attribute="name"),
        _entity(per, "Function+Parameter", Function="name", Parameter="parameter"),
        _entity(per.where("parameter <> 'self'"), "Context+Variable", Context="code", Variable="parameter"),
    ]
    out += [x.withColumn("rule", F.lit("Term")) for x in out[:3]]
    if modules is not None:
        named = lambda rows: rows.join(modules.select(F.col("file"), F.col("module").alias("_module")), "file")
        out += [_entity(named(c), "Module", Module="_module", Class="name"), _entity(named(f), "Module", Module="_module", Function="name"), _entity(named(m), "Module", Module="_module", Class="class_name", Method="name")]
        out += [x.withColumn("rule", F.lit("Term")) for x in out[-3:]]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def questions(templates: DataFrame, things: DataFrame, rules: tuple[tuple[str, ...], ...] = RULES_V1, valid: tuple[str, ...] = TAGS_V1, strict: bool = True) -> DataFrame:
    """(category, template, rule, question, codes). The templates are the small side of an equi-join on the rule."""
    chosen = dispatched(admitted(templates, valid), rules, strict)
    rows = chosen.join(things, "rule")
    # A module's rule serves templates with sub-tags: only entities that have a value for each.
    rows = rows.where((F.col("rule") != "Module") | (F.size(F.array_except("tags", F.map_keys("values"))) == 0))
    return rows.select("category", "template", "rule", filled(F.col("template"), F.col("values")).alias("question"), "codes")


def distinct_replacements(rows: DataFrame) -> DataFrame:
    """Of rows with the same replacements the first."""
    return dedup.by_items(rows, "items")


def logic_questions(classes: DataFrame, functions: DataFrame, templates: DataFrame) -> DataFrame:
    """<Logic> templates filled with the first sentence of each docstring of classes, functions and methods."""
    docs = classes.select("docstring", "code").union(functions.select("docstring", "code")).where("docstring is not null and trim(docstring) <> ''")
    logic = docs.select(F.create_map(F.lit("Logic"), F.trim(T.first_sentence(F.col("docstring")))).alias("values"), F.array("code").alias("codes"))
    mine = admitted(templates).where(F.array_contains("tags", "Logic") & (F.size("tags") == 1))
    # Templates are a bounded list; each docstring meets them all.
    return logic.join(small(mine)).select("category", "template", filled(F.col("template"), F.col("values")).alias("question"), "codes")


# The five sides of a statement that are asked about.
DIMENSIONS = ("what", "why", "where", "how", "relationship")


def statement_questions(statements: DataFrame) -> DataFrame:
    """A stand-in question for each side of a statement, as used when no model answers."""
    return statements.where("trim(statement) <> ''").select("*", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension")).withColumn("question", F.format_string("[%s] %s", "dimension", "statement"))


# Tags of where-questions, each category's rules in their order, and features that any class may be asked for.
WHERE_TAGS = ("Class", "Function", "Method", "Variable", "Attribute", "Parameter", "Module")
CATEGORY_RULES = {
    "Where": (("Class", "Method"), ("Class", "Attribute"), ("Class",), ("Function",), ("Method",), ("Module",)),
    "What": (
        ("Term",), ("Class", "Method"), ("Class", "Attribute"), ("Class", "Field"), ("Class", "Parameter"), ("Class", "Module"), ("Class",), ("Function", "Module"), ("Function", "Context"),
        ("Function", "Logic"), ("Function", "Parameter"), ("Function",), ("Method", "Parameter"), ("Method",), ("Variable",),
    ),
    "How": (
        ("Class", "Variable"), ("Class", "Method"), ("Class", "Feature"), ("Class",), ("Method", "Logic"), ("Method", "Object"), ("Method",), ("Function", "Decorator"), ("Function", "Logic"),
        ("Function", "Context"), ("Function", "Variable"), ("Function",), ("Attribute", "Context"), ("Variable",),
    ),
}
FEATURES = ("data validation", "error handling", "configuration management", "serialization")
FEATURE = r"(?i)(?:handles|manages|supports|provides) ([a-zA-Z\s]+)"
OBJECT = r"([A-Z][a-zA-Z0-9_]*)\("
DECORATOR = r"@([a-zA-Z_][a-zA-Z0-9_]*)"
ASSIGNED = r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?!.*=)"


def _self_names(functions: DataFrame) -> DataFrame:
    """functions with `_used`, each name that follows `self.` in the code and each start of one: a name that the code holds
    after `self.` as a substring, so that the search becomes an equi-join."""
    names = F.array_distinct(F.regexp_extract_all("code", F.lit(r"self\.(?=([\p{L}\p{N}_]+))"), F.lit(1)))
    starts = F.flatten(F.transform(names, lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda k: F.left(n, k))))
    return functions.select("*", F.explode(F.array_distinct(starts)).alias("_used"))


def _codes(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and `_codes`, the rows' code in scan order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "pos", "code"))), lambda x: x["code"]).alias("_codes"))


def category_entities(classes: DataFrame, functions: DataFrame, attributes: DataFrame, modules: DataFrame) -> DataFrame:
    """(rule, values, codes) of the rules of CATEGORY_RULES, a rule's name led by its category.

    Names of what a method uses are those after `self.` in its code. Rules without an entity (a how-question with Method
    alone) hide later ones all the same. A class's first `__init__` gives its parameters."""
    c = classes.where("code is not null")
    module = modules.select("file", F.col("module").alias("_module"))
    f = functions.where("code is not null")
    own = c.select(F.col("name").alias("class_name"), F.col("code").alias("class_code"), F.col("docstring").alias("_doc"))
    m = f.where("is_method").join(classes.select(F.col("name").alias("class_name"), F.col("code").alias("class_code")).distinct(), "class_name")
    mc = m.where("class_code is not null")
    a = attributes.select("class_name", F.col("name").alias("attribute")).join(own.drop("_doc"), "class_name")
    used = _self_names(f.select("file", "pos", "name", "class_name", "is_method", "code"))
    by_class = used.where("is_method").select("class_name", F.col("_used").alias("attribute"), "file", "pos", "code", "name")
    sentence = T.first_sentence(F.col("docstring"))
    text = lambda spare, c=F.col("docstring"): F.when(F.coalesce(F.col("docstring"), F.lit("")) != "", c).otherwise(spare)
    both = F.array("class_code", "code")
    no_code = F.array().cast("array<string>")

    def rows(of: DataFrame, rule: str, codes: Column | None = None, **values: str | Column) -> DataFrame:
        pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.col(v))]
        return of.select(F.lit(rule).alias("rule"), F.create_map(*pairs).alias("values"), (F.array("code") if codes is None else codes).alias("codes"))

    first = F.row_number().over(Window.partitionBy("class_name").orderBy("file", "pos"))
    init = mc.where("name = '__init__'").withColumn("_n", first).where("_n = 1").select("class_name", "class_code", "code", F.explode("parameters").alias("parameter")).where("parameter <> 'self'")
    per = f.select("name", "is_method", "class_name", "code", F.explode("parameters").alias("parameter"))
    per_method = m.select("name", "code", F.explode("parameters").alias("parameter")).where("parameter <> 'self'")
    in_module = f.join(module, "file").where("coalesce(_module, '') <> ''")
    anywhere = _codes(used.withColumnRenamed("_used", "attribute"), "attribute")
    in_class = _codes(by_class, "class_name", "attribute")
    callers = by_class.select("class_name", F.col("attribute").alias("called"), F.col("file").alias("_file"), F.col("pos").alias("_pos"), F.col("code").alias("_code"))
    called = mc.select("class_name", "class_code", F.col("name").alias("called"), "file", "pos", "code").join(callers, ["class_name", "called"], "left")
    other = F.when(F.col("_code").isNotNull() & ~((F.col("_file") == F.col("file")) & (F.col("_pos") == F.col("pos"))), F.struct("_file", "_pos", "_code"))
    called = called.groupBy("class_name", "class_code", "called", "file", "pos", "code").agg(F.transform(F.array_sort(F.collect_list(other)), lambda x: x["_code"]).alias("_codes"))
    phrases = c.select(F.explode(F.regexp_extract_all("docstring", F.lit(FEATURE), F.lit(1))).alias("feature")).distinct()
    few = phrases.limit(3).agg((F.count("*") < 3).alias("few")).where("few")
    usual = few.select(F.explode(F.array(*map(F.lit, FEATURES))).alias("feature"))
    features = small(phrases.union(usual).distinct())
    objects = m.select("name", "class_name", "code", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(OBJECT), F.lit(1)))).alias("object")).where("object <> class_name")
    decorators = f.select("name", "code", F.explode(F.regexp_extract_all("code", F.lit(DECORATOR), F.lit(1))).alias("decorator"))
    assigned = F.filter(F.transform(F.split("code", "\n"), lambda x: F.regexp_extract(x, ASSIGNED, 1)), lambda x: x != "")
    variables = f.select("name", "code", F.explode(F.concat(assigned, F.coalesce("parameters", no_code))).alias("variable"))
    with_users = a.join(in_class, ["class_name", "attribute"], "left")
    term = f.join(own.select("class_name", "class_code").dropDuplicates(["class_name"]), "class_name", "left")
    out = [
        rows(mc, f"{k}:Class+Method", both, Class="class_name", Method="name") for k in ("Where", "What")
    ] + [rows(a, f"{k}:Class+{t}", F.array("class_code"), Class="class_name", **{t: "attribute"}) for k, t in (("Where", "Attribute"), ("What", "Attribute"), ("What", "Field"))] + [
        rows(c, f"{k}:Class", Class="name") for k in CATEGORY_RULES
    ] + [
        rows(f.where("not is_method"), "Where:Function", Function="name"),
        rows(m, "Where:Method", F.array_compact(F.array("code", "class_code")), Method="name"),
        rows(c.join(module, "file", "left"), "Where:Module", Module=F.coalesce("_module", F.lit(""))),
        rows(c, "What:Term", Term="name"), rows(term, "What:Term", F.array_compact(F.array("code", F.when(F.col("is_method"), F.col("class_code")))), Term="name"),
        rows(init, "What:Class+Parameter", both, Class="class_name", Parameter="parameter"),
        rows(c.join(module, "file").where("coalesce(_module, '') <> ''"), "What:Class+Module", Class="name", Module="_module"),
        rows(in_module, "What:Function+Module", Function="name", Module="_module"),
        *[rows(f, f"What:Function+{t}", Function="name", **{t: text("the codebase")}) for t in ("Context", "Logic")],
        rows(per, "What:Function+Parameter", Function="name", Parameter="parameter"),
        rows(f, "What:Function", Function="name"),
        rows(per_method, "What:Method+Parameter", Method="name", Parameter="parameter"),
        rows(m, "What:Method", Method="name"),
        rows(attributes.select(F.col("name").alias("attribute")).join(anywhere, "attribute"), "What:Variable", F.col("_codes"), Variable="attribute"),
        rows(with_users, "How:Class+Variable", F.concat(F.array("class_code"), F.coalesce("_codes", no_code)), Class="class_name", Variable="attribute"),
        rows(called, "How:Class+Method", F.concat(both, "_codes"), Class="class_name", Method="called"),
        rows(c.join(features), "How:Class+Feature", Class="name", Feature="feature"),
        rows(m.where("coalesce(docstring, '') <> ''"), "How:Method+Logic", Method="name", Logic=sentence),
        rows(objects, "How:Method+Object", Method="name", Object="object"),
        rows(decorators, "How:Function+Decorator", Function="name", Decorator="decorator"),
        *[rows(f, f"How:Function+{t}", Function="name", **{t: text("this codebase", sentence)}) for t in ("Logic", "Context")],
        rows(variables, "How:Function+Variable", Function="name", Variable="variable"),
        rows(f, "How:Function", Function="name"),
        rows(attributes.select("class_name", F.col("name").alias("attribute")).join(by_class, ["class_name", "attribute"]), "How:Attribute+Context", Attribute="attribute", Context="name"),
        rows(attributes.select("class_name", F.col("name").alias("attribute")).join(in_class, ["class_name", "attribute"]), "How:Variable", F.col("_codes"), Variable="attribute"),
    ]
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def category_questions(templates: DataFrame, things: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """(category, template, rule, question, codes) by each category's own rules. Of the where-questions only those with known
    tags count; a how-question that no rule fits and that speaks of tests is asked once, with the code of all functions in
    test files (`tests`: file, pos, code), if there is any."""
    chosen = None
    for category, rules in CATEGORY_RULES.items():
        mine = templates.where(F.col("category") == category).withColumn("tags", tags(F.col("template")))
        if category == "Where":
            mine = mine.where(F.forall("tags", lambda t: t.isin(*WHERE_TAGS)))
        ruled = dispatched(mine, rules).withColumn("rule", F.concat(F.lit(f"{category}:"), "rule"))
        chosen = ruled if chosen is None else chosen.unionByName(ruled)
        if category == "How" and tests is not None:
            # No rule fits if no rule's tags are all there.
            unruled = mine.where(~F.greatest(*[F.size(F.array_except(F.array(*map(F.lit, r)), F.col("tags"))) == 0 for r in rules]))
            about = unruled.where(F.lower("template").contains("test") | F.contains("template", F.lit("测试")))
            codes = tests.where("lower(file) like '%test%' and code is not null").agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "pos", "code"))), lambda x: x["code"]).alias("codes")).where("size(codes) > 0")
            asked = about.join(F.broadcast(codes)).select("category", "template", F.lit("How:Test").alias("rule"), F.col("template").alias("question"), "codes")
    rows = chosen.join(things, "rule").select("category", "template", "rule", filled(F.col("template"), F.col("values")).alias("question"), "codes")
    return rows if tests is None else rows.unionByName(asked)
