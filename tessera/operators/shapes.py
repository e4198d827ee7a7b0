"""Shapes over the caller's own query: small groups are suppressed and aggregates
of noised columns get noise, by rewriting the analysed plan.

Lineage is followed by attribute id, not by name: a noised column that reaches the
result, a predicate, a group or join key, a window or DISTINCT other than through
an aggregate is refused.  The rewrite enters scalar, IN and EXISTS subqueries of
any node, and common table expressions, which it writes out where they are used."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..compiler import Compiled
from ..errors import fail
from .governed import Caller, active_shapes, laplace, view


def _seq(jseq):
    return [jseq.apply(i) for i in range(jseq.size())]


class Rewriter:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.parser = spark._jsparkSession.sessionState().sqlParser()

    def jseq(self, items):
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)

    def kind(self, plan) -> str:
        return plan.getClass().getSimpleName()

    def frame(self, plan) -> DataFrame:
        data = self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        return DataFrame(data, self.spark)

    def subqueries(self, e, visit):
        """``e`` with the plans of its subqueries rewritten."""
        kids = _seq(e.children())
        new = [self.subqueries(k, visit) for k in kids]
        if any(a is not b for a, b in zip(kids, new)):
            e = e.withNewChildren(self.jseq(new))
        if self.is_query(e):
            e = e.withNewPlan(visit(e.plan()))
        return e

    @staticmethod
    def is_query(e) -> bool:
        return e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery")

    def has_query(self, e) -> bool:
        return self.is_query(e) or any(self.has_query(k) for k in _seq(e.children()))

    def nodes(self, plan):
        yield plan
        for k in _seq(plan.children()):
            yield from self.nodes(k)
        for e in _seq(plan.expressions()):
            yield from self.in_expr(e)

    def in_expr(self, e):
        if self.is_query(e):
            yield from self.nodes(e.plan())
        for k in _seq(e.children()):
            yield from self.in_expr(k)

    def rebuild(self, plan, visit):
        kids = _seq(plan.children())
        new = [visit(k) for k in kids]
        if kids and any(a is not b for a, b in zip(kids, new)):
            plan = plan.withNewChildren(self.jseq(new))
        if any(self.has_query(e) for e in _seq(plan.expressions())):
            plan = self.copy(plan, lambda e: self.subqueries(e, visit))
        return plan

    def copy(self, plan, change):
        """``plan`` with each of its expressions changed, however the node holds them."""
        gateway = self.spark.sparkContext._gateway
        is_a = lambda x, name: hasattr(x, "getClass") and is_instance_of(gateway, x, name)

        def arg(x):
            if is_a(x, "org.apache.spark.sql.catalyst.expressions.Expression"):
                return change(x)
            if is_a(x, "scala.collection.immutable.Seq"):
                return self.jseq([arg(i) for i in _seq(x)])
            if is_a(x, "scala.Some"):
                return self.jvm.scala.Some(arg(x.get()))
            return x

        args = gateway.new_array(self.jvm.java.lang.Object, plan.productArity())
        for i in range(plan.productArity()):
            args[i] = arg(plan.productElement(i))
        return plan.makeCopy(args)

    def inline(self, plan):
        """Common table expressions written out; recursive ones stay loops."""
        if not any(self.kind(n) == "WithCTE" for n in self.nodes(plan)):
            return plan
        return self.jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False).apply(plan)

    def groups(self, plan) -> bool:
        """Whether a node makes one row of several."""
        name = self.kind(plan)
        return name in ("Aggregate", "Distinct", "Deduplicate") or name in ("Intersect", "Except") and not plan.isAll()

    def grouped(self, child, keys: list):
        """An aggregate that keeps one row of each combination of ``keys``."""
        ls, exprs = self.jvm.org.apache.spark.sql.catalyst.plans.logical, self.jvm.org.apache.spark.sql.catalyst.expressions
        ids = {k.exprId().id() for k in keys}
        some = lambda a: self.alias(exprs.aggregate.First(a, False).toAggregateExpression(), a.name(), a.exprId())
        out = [a if a.exprId().id() in ids else some(a) for a in _seq(child.output())]
        return ls.Aggregate(self.jseq(keys), self.jseq(out), child, self.jvm.scala.Option.empty())

    def suppress(self, plan, k: int):
        """Groups under ``k`` rows go, in every aggregate, DISTINCT and Deduplicate, and
        of the left side of INTERSECT and EXCEPT, whose rows they make distinct."""
        ls = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        visit = lambda p: self.suppress(p, k)
        plan = self.rebuild(plan, visit)
        name = self.kind(plan)
        if name in ("Intersect", "Except") and not plan.isAll():
            left = self.large(self.grouped(plan.left(), _seq(plan.left().output())), k)
            return plan.withNewChildren(self.jseq([left, plan.right()]))
        if name in ("Distinct", "Deduplicate"):
            plan = self.grouped(plan.child(), _seq(plan.child().output() if name == "Distinct" else plan.keys()))
        return self.large(plan, k) if self.kind(plan) == "Aggregate" else plan

    def large(self, plan, k: int):
        """An aggregate's groups of ``k`` rows or more."""
        ls = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        out = _seq(plan.output())
        size = self.named("count(1)", "__group_size")
        inner = ls.Aggregate(plan.groupingExpressions(), self.jseq([*_seq(plan.aggregateExpressions()), size]), plan.child(), plan.hint())
        attr = size.toAttribute()
        lit = self.parser.parseExpression(f"{int(k)}L")
        test = self.jvm.org.apache.spark.sql.catalyst.expressions.GreaterThanOrEqual(attr, lit)
        return ls.Project(self.jseq(out), ls.Filter(test, inner))

    def named(self, sql: str, name: str):
        """An analysed aggregate expression under a new name and id."""
        plan = self.spark.range(1).selectExpr(f"{sql} AS {name}")._jdf.queryExecution().analyzed()
        return plan.aggregateExpressions().apply(0)

    # ---- noise

    def ids(self, e) -> set[int]:
        return {a.exprId().id() for a in _seq(e.references().toSeq())}

    def noise(self, plan, tainted: dict[int, frozenset], scales: dict[str, float], used: set[str]):
        """``plan`` with noise above aggregates that read tainted attributes;
        ``tainted`` (attribute id -> noised columns) grows by what is derived from
        them, ``used`` by the columns that aggregates read."""
        plan = self.rebuild(plan, lambda p: self.noise(p, tainted, scales, used))
        name = self.kind(plan)
        ls = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        reads = lambda e: self.ids(e) & set(tainted)
        origin = lambda hit: frozenset().union(*(tainted[i] for i in hit))
        if name in ("Project", "SubqueryAlias", "View", "Union", "Expand"):
            if name == "Project":
                for e in _seq(plan.projectList()):
                    hit = reads(e)
                    if hit:
                        tainted[e.exprId().id()] = origin(hit)
            if name == "Union":
                for i, o in enumerate(_seq(plan.output())):
                    hit = {_seq(k.output())[i].exprId().id() for k in _seq(plan.children())} & set(tainted)
                    if hit:
                        tainted[o.exprId().id()] = origin(hit)
            if name == "Expand":  # grouping sets: the rows of each set side by side
                for i, o in enumerate(_seq(plan.output())):
                    hit = set().union(*(reads(_seq(row)[i]) for row in _seq(plan.projections())))
                    if hit:
                        tainted[o.exprId().id()] = origin(hit)
            return plan
        if name != "Aggregate":
            for e in _seq(plan.expressions()):
                if reads(e):
                    raise fail("unsupported", f"a noised column is read by {name} outside an aggregate")
            return plan
        for e in _seq(plan.groupingExpressions()):
            if reads(e):
                raise fail("unsupported", "a noised column cannot be grouped by")
        inner, outer, hit_any = [], [], False
        for e in _seq(plan.aggregateExpressions()):
            hit = reads(e)
            if not hit:
                inner.append(e)
                outer.append(e.toAttribute())
                continue
            hit_any = True
            used |= origin(hit)
            exprs = self.jvm.org.apache.spark.sql.catalyst.expressions
            fresh = exprs.NamedExpression.newExprId()
            raw = self.alias(e.child() if self.kind(e) == "Alias" else e, "__raw", fresh)
            inner.append(raw)
            outer.append((e, raw.toAttribute(), max(scales[x] for x in origin(hit))))
        if not hit_any:
            return plan
        base = ls.Aggregate(plan.groupingExpressions(), self.jseq(inner), plan.child(), plan.hint())
        final = []
        for o in outer:
            if not isinstance(o, tuple):
                final.append(o)
                continue
            e, attr, scale = o
            kind = attr.dataType().sql()
            raw = F.col("x")
            noisy = laplace(raw, scale)
            if kind in ("BIGINT", "INT", "SMALLINT", "TINYINT"):
                noisy = F.round(noisy)
            noisy = noisy.cast(kind.lower())
            # analyse over a column of that type, then put the attribute in its place
            shell = self.spark.sql(f"SELECT CAST(NULL AS {kind}) AS x").select(noisy.alias("y"))._jdf.queryExecution().analyzed()
            body = _seq(shell.projectList())[0].child()
            body = self.swap(body, attr)
            final.append(self.alias(body, e.name(), e.exprId()))
        return ls.Project(self.jseq(final), base)

    def swap(self, e, attr):
        if self.kind(e) == "AttributeReference" and e.name() == "x":
            return attr
        kids = _seq(e.children())
        return e.withNewChildren(self.jseq([self.swap(k, attr) for k in kids])) if kids else e

    def alias(self, child, name: str, expr_id):
        exprs = self.jvm.org.apache.spark.sql.catalyst.expressions
        none = self.jvm.scala.Option.empty()
        return exprs.Alias(child, name, expr_id, self.jseq([]), none, self.jseq([]))


def govern(query: DataFrame | str, governed: DataFrame, c: Compiled, caller: Caller) -> tuple[DataFrame, dict[str, float]]:
    """The caller's query, shaped, and what it costs each privacy budget (the
    largest epsilon).  ``query`` is over ``governed``, the caller's view."""
    spark = governed.sparkSession
    df = spark.sql(query) if isinstance(query, str) else query
    shapes = active_shapes(c, caller)
    rw = Rewriter(spark)
    plan = df._jdf.queryExecution().analyzed()
    charges: dict[str, float] = {}
    read = columns_read(rw, plan, governed)
    for s in shapes:
        if s.operator == "noise" and s.params["at"] == "row" and s.column in read:
            charges[s.params["budget"]] = max(charges.get(s.params["budget"], 0.0), float(s.params["epsilon"]))
    noisy = [s for s in shapes if s.operator == "noise" and s.params["at"] == "aggregate"]
    if noisy:
        # by the view's top projection, wherever the plan holds it
        plan = rw.inline(plan)
        scales = {s.column: s.params["sensitivity"] / s.params["epsilon"] for s in noisy}
        top = [a.name() for a in _seq(governed._jdf.queryExecution().analyzed().output())]
        tainted: dict[int, frozenset] = {}
        for n in rw.nodes(plan):
            if rw.kind(n) == "Project" and [a.name() for a in _seq(n.output())] == top:
                tainted.update({a.exprId().id(): frozenset([a.name()]) for a in _seq(n.output()) if a.name() in scales})
        used: set[str] = set()
        plan = rw.noise(plan, tainted, scales, used)
        if {a.exprId().id() for a in _seq(plan.output())} & set(tainted):
            raise fail("unsupported", "a noised column is returned outside an aggregate")
        for s in noisy:
            if s.column in used:
                charges[s.params["budget"]] = max(charges.get(s.params["budget"], 0.0), float(s.params["epsilon"]))
    ks = [s.params["k"] for s in shapes if s.operator == "suppress"]
    if ks:
        grouped = any(rw.groups(n) for n in rw.nodes(plan))
        plan = rw.suppress(plan, max(ks))
        if not grouped:
            out = rw.frame(plan)
            size = out.limit(max(ks)).agg(F.count(F.lit(1)).alias("__n"))  # k rows are enough to know
            return out.join(F.broadcast(size.where(F.col("__n") >= max(ks)).drop("__n").select(F.lit(1).alias("__ok"))), F.lit(True), "left_semi"), charges
    return rw.frame(plan), charges


def columns_read(rw: Rewriter, plan, governed: DataFrame) -> set[str]:
    """Names of the view's columns that an analysed query depends on, by following
    attributes from its output down to the view's projection; other tables' columns
    of equal names do not count.  What lies in a common table expression counts whole."""
    views = [a.name() for a in _seq(governed._jdf.queryExecution().analyzed().output())]
    output = lambda p: {a.exprId().id() for a in _seq(p.output())}
    found: set[str] = set()

    def queries(e):
        if rw.is_query(e):
            follow(e.plan(), output(e.plan()))
        for k in _seq(e.children()):
            queries(k)

    def follow(p, need: set[int]) -> None:
        name, kids, exprs = rw.kind(p), _seq(p.children()), _seq(p.expressions())
        if name == "Project" and [a.name() for a in _seq(p.output())] == views:
            found.update(a.name() for a in _seq(p.output()) if a.exprId().id() in need)
            return
        for e in exprs:
            queries(e)
        if name == "WithCTE":
            for d in _seq(p.cteDefs()):
                follow(d.child(), output(d.child()))
            follow(p.plan(), need)
            return
        if name == "Union":
            at = [i for i, a in enumerate(_seq(p.output())) if a.exprId().id() in need]
            for k in kids:
                out = _seq(k.output())
                follow(k, {out[i].exprId().id() for i in at})
            return
        if name in ("Project", "Aggregate"):
            # what is computed but not asked for is not read
            exprs = _seq(p.projectList()) if name == "Project" else _seq(p.aggregateExpressions())
            exprs = [e for e in exprs if e.exprId().id() in need] + ([] if name == "Project" else _seq(p.groupingExpressions()))
            need = set()
        for e in exprs:
            need = need | rw.ids(e)
        for k in kids:
            follow(k, output(k) if name in ("Distinct", "Intersect", "Except", "Deduplicate") else need)

    follow(plan, output(plan))
    return found


__all__ = ["govern", "view"]
