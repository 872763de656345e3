"""URL filter: allow and block rules, else a tree of path templates judged by its labels.

A url's path is cut into segments; runs of digits in them become ``*`` at once. Per host
the tree is then walked level by level. Under each parent template the children are
counted (urls, labelled ones, bad ones), and

- where the parent has more than ``max_children`` children, those of fewer than ``min_urls``
  urls are a variable segment, ``*``;
- the other labelled ones are put in order of their smoothed share of bad labels, in steps of
  1 / ``STEPS``; a step's branches are statistically similar to a group and merge with it if they
  differ by no more than ``z`` standard errors both from all labels of the group and from its
  first step, so a chain of small differences does not join opposites. A group of several children
  is ``*`` if all of them are in it, else ``*1``, ``*2`` and so on; a child alone keeps its name;
- children without labels are kept apart, as nothing says that they are alike.

With ``whole`` the tree is walked to its real depth; below ``max_depth`` levels a path that
is the only one left under its template takes its other segments at once, so the number of
levels, each a few jobs, is that of the deepest fork. Without ``whole``, as in the SQL,
segments from the ``max_depth``-th on are one, ``**``. A template is blocked if its purity,
the share of good labels smoothed by ``strength`` labels at the overall share, is below
``purity``. Only counts per distinct host and path shape are shuffled from level to level;
they come from one aggregation with map-side sums, so a host with most of the urls is as
cheap as others, and siblings are put in order by their at most ``STEPS`` + 1 steps.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged
by that (empty) template; a host without labels gets the overall share; without any
labels the overall bad share counts as one half. Urls may repeat; each row is judged. An
empty table gives no rows. Of the pages only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import inputs
from ledgerloom.plans.scratch import written

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
BROADCAST_CHARS = 8_000_000
STEPS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    max_depth: int = 6
    max_children: int = 20
    min_urls: int = 5
    z: float = 2.0
    strength: float = 5.0
    purity: float = 0.5
    whole: bool = False


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path of a url; both empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null if none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _segments(shape: Column) -> Column:
    """The segments after the leading slash."""
    return F.when(shape == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(shape, "^/", ""), "/", -1))


def _cut(tree: DataFrame, limits: Limits) -> DataFrame:
    """``tree`` with the segments from the ``max_depth``-th on as one."""
    cut = F.concat(F.slice("segments", 1, limits.max_depth - 1), F.array(F.lit("**")))
    return tree.withColumn("segments", F.when(F.size("segments") > limits.max_depth, cut).otherwise(F.col("segments")))


def _without_forks(tree: DataFrame, level: int) -> DataFrame:
    """``tree`` with the segments from ``level`` on taken over where no other path is left under the template."""
    more = F.size("segments") > level
    alone = tree.where(more).groupBy("host", "template").agg(F.count("*").alias("paths")).where("paths = 1")
    done = more & F.col("paths").isNotNull()
    rest = F.array_join(F.slice(F.col("segments"), F.lit(level + 1), F.size("segments")), "/")
    return tree.join(alone, ["host", "template"], "left").select(
        "host", "shape", "n", "labelled", "bad", F.when(done, F.slice("segments", 1, level)).otherwise(F.col("segments")).alias("segments"),
        F.when(done, F.concat("template", F.lit("/"), rest)).otherwise(F.col("template")).alias("template"),
    )


def _differ(labelled: Column, bad: Column, other_labelled: Column, other_bad: Column, z: float) -> Column:
    """Whether two shares of bad labels are more than ``z`` pooled standard errors apart."""
    pooled = (bad + other_bad) / (labelled + other_labelled)
    error = z * F.sqrt(pooled * (1 - pooled) * (1 / labelled + 1 / other_labelled))
    return F.abs(bad / labelled - other_bad / other_labelled) > error


def _grouped(run: Column, z: float) -> Column:
    """The steps of an ordered array (step, labelled, bad, members) as (step, members, group): each joins the group before it, or begins one."""
    state = "struct<out: array<struct<step: int, members: bigint, group: bigint>>, no: bigint, labelled: bigint, bad: bigint, first_labelled: bigint, first_bad: bigint>"
    begin = F.from_json(F.lit('{"out": [], "no": -1, "labelled": 0, "bad": 0, "first_labelled": 0, "first_bad": 0}'), state)

    def join(acc: Column, x: Column) -> Column:
        apart = _differ(x["labelled"], x["bad"], acc["labelled"], acc["bad"], z) | _differ(x["labelled"], x["bad"], acc["first_labelled"], acc["first_bad"], z)
        new = F.when(acc["no"] < 0, True).otherwise(apart)
        no = acc["no"] + new.cast("long")
        held = lambda own, with_: F.when(new, own).otherwise(with_)
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(x["step"].alias("step"), x["members"].alias("members"), no.alias("group")))).alias("out"), no.alias("no"),
            held(x["labelled"], acc["labelled"] + x["labelled"]).alias("labelled"), held(x["bad"], acc["bad"] + x["bad"]).alias("bad"),
            held(x["labelled"], acc["first_labelled"]).alias("first_labelled"), held(x["bad"], acc["first_bad"]).alias("first_bad"),
        )

    return F.aggregate(run, begin, join, lambda acc: acc["out"])


def _merged(child: DataFrame, prior: float, limits: Limits) -> DataFrame:
    """(host, template, segment, as): what each child is called from here on."""
    key = ["host", "template"]
    parent = child.groupBy(*key).agg(F.count("*").alias("children"))
    rare = (F.col("children") > limits.max_children) & (F.col("c_n") < limits.min_urls)
    share = (F.col("c_bad") + limits.strength * prior) / (F.col("c_labelled") + limits.strength)
    step = F.when(rare, -1).when(F.col("c_labelled") == 0, -2).otherwise(F.floor(share * STEPS + 0.5)).cast("int")
    judged = child.join(parent, key).withColumn("step", step)
    steps = judged.where("step >= 0").groupBy(*key, "step").agg(F.sum("c_labelled").alias("labelled"), F.sum("c_bad").alias("bad"), F.count("*").alias("members"))
    # at most STEPS + 1 rows a parent
    runs = steps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("step", "labelled", "bad", "members"))).alias("run"))
    numbered = runs.select(*key, F.explode(_grouped(F.col("run"), limits.z)).alias("s")).select(*key, "s.*")
    groups = numbered.withColumns(
        {"size": F.sum("members").over(Window.partitionBy(*key, "group")), "last": F.max("group").over(Window.partitionBy(*key))}
    )
    name = F.when(F.col("size") > 1, F.when(F.col("last") == 0, "*").otherwise(F.concat(F.lit("*"), (F.col("group") + 1).cast("string"))))
    named = groups.select(*key, "step", name.alias("name"))
    called = F.when(F.col("step") == -1, "*").otherwise(F.coalesce("name", "segment"))
    return judged.join(named, [*key, "step"], "left").select(*key, "segment", called.alias("as"))


def template_verdicts(urls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, shape, template, purity, template_verdict) for every host and path shape of ``urls`` (host, shape, bad).

    ``bad`` is 1, 0 or null (not labelled).
    """
    total = urls.agg(F.sum("bad"), F.count("bad")).first()  # two numbers
    prior = total[0] / total[1] if total[1] else 0.5
    a = limits.strength
    tree = written(
        urls.groupBy("host", "shape")
        .agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .select("*", _segments(F.col("shape")).alias("segments"), F.lit("").alias("template")),
        "paths",
    )
    levels = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    if not limits.whole:
        tree, levels = _cut(tree, limits), min(levels, limits.max_depth)
    level = -1
    while (level := level + 1) < levels:
        if level >= limits.max_depth:
            tree = written(_without_forks(tree, level), "paths")
            levels = tree.agg(F.max(F.size("segments"))).first()[0]
        here = tree.withColumn("segment", F.get("segments", F.lit(level)))
        child = (
            here.where("segment is not null")
            .groupBy("host", "template", "segment")
            .agg(F.sum("n").alias("c_n"), F.sum("labelled").alias("c_labelled"), F.sum("bad").alias("c_bad"))
        )
        merged = _merged(child, prior, limits)
        step = F.when(F.col("as").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "as"))
        tree = here.join(merged, ["host", "template", "segment"], "left").select(
            "host", "shape", "n", "labelled", "bad", "segments", step.alias("template")
        )
        tree = written(tree, "paths")
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"))
    purity = (F.col("t_labelled") - F.col("t_bad") + a * (1 - prior)) / (F.col("t_labelled") + a)
    sums = sums.select("host", "template", purity.alias("purity"))
    return tree.join(sums, ["host", "template"]).select(
        "host", "shape", "template", "purity", F.when(F.col("purity") < limits.purity, "block").otherwise("allow").alias("template_verdict")
    )


def judge(urls: DataFrame, rules=RULES, limits: Limits = Limits(whole=True)) -> DataFrame:
    """``urls`` (with url and bad) with the columns host, path, rule, verdict, template and purity."""
    host, path = host_and_path(F.col("url"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "template", "purity", "shape", "bad", "template_verdict")]
    parts = urls.select(*kept, host.alias("host"), path.alias("path"), "bad").withColumn("shape", F.regexp_replace("path", r"[0-9]+", "*"))
    verdicts = written(template_verdicts(parts.select("host", "shape", "bad"), limits), "verdicts")
    size = verdicts.agg(F.sum(F.length("host") + F.length("shape") + F.length("template") + 32)).first()[0] or 0
    side = F.broadcast(verdicts) if size <= BROADCAST_CHARS else verdicts
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.join(side, ["host", "shape"], "left").select(
        *kept, "host", "path", rule.alias("rule"), F.coalesce(says, F.col("template_verdict")).alias("verdict"), "template", "purity"
    )


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page is bad if the document that its path ends with has a quality of 0."""
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(host_and_path(F.col("url"))[1], r"([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long")
    labels = inputs.table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    numbered = pages.withColumn("doc_id", number)
    # pages without a number would all have one key in the join
    labelled = numbered.where("doc_id IS NOT NULL").join(labels, "doc_id", "left").unionByName(numbered.where("doc_id IS NULL").withColumn("quality", F.lit(None).cast("long")), allowMissingColumns=True)
    return judge(labelled.select("page_id", "url", F.when(F.col("quality").isin(0, 1), 1 - F.col("quality")).alias("bad"))).drop("url")


def _oracle(limits: Limits = Limits()) -> str:
    """The same as DuckDB SQL; every level is three subqueries."""
    a, d = limits.strength, limits.max_depth
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [
        f"(host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')"
        for _, t in rules
    ]
    case = lambda i: "CASE " + " ".join(f"WHEN {f} THEN '{r[i]}'" for f, r in zip(fits, rules, strict=True)) + " END"
    differ = lambda l, b: (
        f"(abs(r.b / r.l - {b} / {l}) > {limits.z}::DOUBLE * sqrt((r.b + {b}) / (r.l + {l}) * (1 - (r.b + {b}) / (r.l + {l})) * (1 / r.l + 1 / {l})))"
    )
    levels = ""
    for k in range(d):
        levels += f"""
, here{k} AS (SELECT *, segments[{k + 1}] AS segment FROM tree{k})
, child{k} AS (SELECT host, template, segment, sum(n) AS c_n, sum(labelled) AS c_labelled, sum(bad) AS c_bad FROM here{k} WHERE segment IS NOT NULL GROUP BY ALL)
, judged{k} AS (SELECT c.*, CASE WHEN children > {limits.max_children} AND c_n < {limits.min_urls} THEN -1 WHEN c_labelled = 0 THEN -2
    ELSE CAST(floor((c_bad + {a}::DOUBLE * prior) / (c_labelled + {a}::DOUBLE) * {STEPS} + 0.5::DOUBLE) AS INTEGER) END AS step
    FROM (SELECT *, count(*) OVER (PARTITION BY host, template) AS children FROM child{k}) AS c, prior)
, steps{k} AS (SELECT host, template, step, sum(c_labelled)::DOUBLE AS l, sum(c_bad)::DOUBLE AS b, count(*) AS members FROM judged{k} WHERE step >= 0 GROUP BY ALL)
, run{k} AS (SELECT *, row_number() OVER (PARTITION BY host, template ORDER BY step) AS i FROM steps{k})
, numbered{k} AS (SELECT host, template, step, members, i, 0 AS no, l, b, l AS fl, b AS fb FROM run{k} WHERE i = 1
  UNION ALL SELECT host, template, step, members, i, no + CASE WHEN apart THEN 1 ELSE 0 END, CASE WHEN apart THEN xl ELSE l + xl END, CASE WHEN apart THEN xb ELSE b + xb END, CASE WHEN apart THEN xl ELSE fl END, CASE WHEN apart THEN xb ELSE fb END
  FROM (SELECT r.host, r.template, r.step, r.members, r.i, n.no, n.l, n.b, n.fl, n.fb, r.l AS xl, r.b AS xb, {differ('n.l', 'n.b')} OR {differ('n.fl', 'n.fb')} AS apart
    FROM numbered{k} AS n JOIN run{k} AS r ON r.host = n.host AND r.template = n.template AND r.i = n.i + 1))
, named{k} AS (SELECT host, template, step, CASE WHEN sum(members) OVER (PARTITION BY host, template, no) > 1 THEN CASE WHEN max(no) OVER (PARTITION BY host, template) = 0 THEN '*'
    ELSE '*' || CAST(no + 1 AS BIGINT) END END AS name FROM numbered{k})
, merged{k} AS (SELECT host, template, segment, CASE WHEN step = -1 THEN '*' ELSE coalesce(name, segment) END AS seg FROM judged{k} LEFT JOIN named{k} USING (host, template, step))
, tree{k + 1} AS (SELECT host, shape, n, labelled, bad, segments, CASE WHEN seg IS NULL THEN template ELSE template || '/' || seg END AS template
    FROM here{k} LEFT JOIN merged{k} USING (host, template, segment))"""
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages)
, h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u)
, p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
, l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
, j AS (SELECT page_id, host, path, regexp_replace(path, '[0-9]+', '*', 'g') AS shape, CASE WHEN quality IN (0, 1) THEN 1 - quality END AS bad
    FROM p LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^/0-9]*/?$', 1) AS BIGINT))
, prior AS (SELECT CASE WHEN count(bad) > 0 THEN sum(bad)::DOUBLE / count(bad) ELSE 0.5 END AS prior FROM j)
, shapes AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad,
    string_split(regexp_replace(shape, '^/', ''), '/') AS parts FROM j GROUP BY host, shape)
, tree0 AS (SELECT host, shape, n, labelled, bad, '' AS template, CASE WHEN shape = '' THEN []::VARCHAR[]
    WHEN len(parts) > {d} THEN list_append(parts[1:{d - 1}], '**') ELSE parts END AS segments FROM shapes){levels}
, pure AS (SELECT host, template, (sum(labelled) - sum(bad) + {a}::DOUBLE * (1 - any_value(prior))) / (sum(labelled) + {a}::DOUBLE) AS purity
    FROM tree{d}, prior GROUP BY host, template)
SELECT page_id, host, path, {case(1)} AS rule,
    coalesce({case(0)}, CASE WHEN purity < {limits.purity} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM j JOIN tree{d} USING (host, shape) JOIN pure USING (host, template)
"""


OP5_SQL = _oracle()
