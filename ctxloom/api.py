"""The ledger and the planner by their tools' names: what a caller asks for, each as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.config import Config
from ctxloom.operators import budget as B
from ctxloom.operators import commit as K
from ctxloom.operators import ledger as L
from ctxloom.operators import units as U
from ctxloom.plans import planner as P
from ctxloom.plans.registry import held
from ctxloom.sources import ledger_files as S


@dataclass(frozen=True)
class MemoryLedger:
    """A ledger folder. Files that it lacks read as their templates."""

    spark: SparkSession
    folder: str

    def files(self) -> DataFrame:
        return S.ledger_files(self.spark, self.folder)

    def lines(self) -> DataFrame:
        return S.ledger_lines(self.files(), history=True)

    def entries(self) -> DataFrame:
        return L.entries(self.lines().where(F.col("file").isin(*L.FILES)))

    def status(self) -> DataFrame:
        return S.status(self.files(), self.entries())

    def search(self, query: str, file: str | None = None, limit: int = 10) -> DataFrame:
        """Lines that hold all words of the query, in file and line order, 1 to 50 of them."""
        return L.search(self.lines() if file is None else self.lines().where(F.col("file") == self._known(file)), query, limit)

    def read(self, file: str, entry: str | None = None) -> DataFrame:
        """The lines of a file, or of one of its entries; an error for what isn't there."""
        lines = self.lines().where(F.col("file") == self._known(file))
        if entry is None:
            return lines
        found = L.section(lines, entry)
        if not found.take(1):
            raise LookupError(f"no entry {entry} in {file}")
        return found

    def _known(self, file: str) -> str:
        if file not in S.TEMPLATES:
            raise LookupError(f"no ledger file {file}")
        return file

    def sidecar(self, name: str = ".provenance.json") -> DataFrame:
        return S.sidecar(self.spark, f"{self.folder}/{name}")

    def provenance(self) -> DataFrame:
        """ACTIVE entries without a source, and why, by id."""
        raw = self.sidecar()
        return L.unresolved_active(self.entries(), S.bindings(raw), S.unresolved(raw)).orderBy("id")

    def memory(self) -> P.Memory:
        """What the planner needs of this ledger. The state entry is one text of bounded size."""
        state = self.entries().where(F.col("id") == L.STATE).select("verbatim").first()
        raw = self.sidecar()
        bound = S.bindings(raw)
        index = L.index(S.ledger_lines(self.files()))
        return P.Memory(index, bound, L.unresolved_active(index, bound, S.unresolved(raw)), (state[0] if state else None) or "")

    def plan_ops(self, ops: DataFrame, log: DataFrame, handles: DataFrame) -> DataFrame:
        """Operations with the reason against each, and the ids of what the accepted ones make."""
        judged = L.atomic(L.validated(L.evidence(L.normalized(ops), log, handles), self.entries()))
        return held(L.minted(held(judged), self.lines().where(F.col("file").isin(*L.FILES))))

    def apply_ops(self, planned: DataFrame) -> DataFrame:
        """(file, content) of the files that the accepted operations change; the others stay as they are."""
        before = self.entries()
        after = L.restored(before, L.applied(before, planned))
        touched = self._touched(before, planned)
        made = L.files(L.rendered(after.join(touched, "file", "left_semi")), L.headers(self.lines()))
        return K.changed(self.files().select("file", "content"), made)

    @staticmethod
    def _touched(before: DataFrame, planned: DataFrame) -> DataFrame:
        """Files that an accepted operation writes."""
        done = planned.where("reason is null")
        where = before.select("id", "file")
        targets = done.where(F.col("op").isin(*L.NEED_TARGET)).join(where, F.col("target_id") == F.col("id")).select("file")
        kinds = F.create_map(*(F.lit(x) for pair in L.KIND_FILE.items() for x in pair))
        fresh = done.where("new_id is not null").select(F.try_element_at(kinds, F.substring_index("new_id", "-", 1)).alias("file"))
        return targets.union(fresh).union(done.where("op = 'UPDATE_STATE'").select(F.lit("STATE.md"))).distinct()


def publish(scored: DataFrame, config: Config = Config()) -> DataFrame:
    """Registers the views plan, plan_units, plan_segments and plan_tiers of scored units; returns the plan.

    The units that a plan shows are the first ``units_shown`` of each session; all count.
    """
    from pyspark.sql.window import Window

    from ctxloom.operators import segments as G

    nth = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    made = P.plan(scored, config)
    made.createOrReplaceTempView("plan")
    scored.withColumn("_nth", nth).where(F.col("_nth") <= config.units_shown).drop("_nth").createOrReplaceTempView("plan_units")
    G.ranked(G.segments(scored, config)).createOrReplaceTempView("plan_segments")
    scored.groupBy("session", "tier").agg(F.count("*").alias("n_units"), F.sum("tokens").alias("tokens")).createOrReplaceTempView("plan_tiers")
    return made


#: Ways in which a plan is carried out.
EXECUTED = ("prune", "semantic", "official")


def executed(done: DataFrame) -> DataFrame:
    """(session, kind, n, last_at): how often and when last each way was taken, ways never taken too.

    ``done`` are (session, kind, n, at): what was carried out, n at a time.
    """
    every = done.select("session").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, EXECUTED))))
    sums = done.groupBy("session", "kind").agg(F.sum("n").cast("long").alias("n"), F.max("at").alias("last_at"))
    return every.join(sums, ["session", "kind"], "left").select("session", "kind", F.coalesce("n", F.lit(0)).alias("n"), "last_at")


def route_settings(routes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(route, window, max_tokens, stale, target, most, margin, configured): what each route is set to and may do.

    ``routes`` (route, target, most, margin) hold what was configured, nulls where nothing was;
    ``capabilities`` (route, window, max_tokens, stale) what the model's backend says, 0 for unknown.
    """
    both = capabilities.join(routes, "route", "full")
    window, most = F.coalesce("window", F.lit(0)), F.coalesce("max_tokens", F.lit(0))
    effective = B.route_budget(window, most, F.col("target"), F.col("most"), F.col("margin"))
    set_ = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("target", "most", "margin"))))
    return both.select("route", window.alias("window"), most.alias("max_tokens"), F.coalesce("stale", F.lit(False)).alias("stale"), effective.alias("e"), set_.alias("configured")).select("route", "window", "max_tokens", "stale", "e.*", "configured")


def publish_state(points: DataFrame, done: DataFrame, routes: DataFrame, capabilities: DataFrame, budgets: DataFrame, ledger: MemoryLedger | None = None) -> None:
    """Registers the views plan_history, plan_executed, route_settings, request_budgets and, of a ledger, provenance.

    ``points`` (session, pos, t, ...) are what plans left behind, of which the ring keeps 240 a session;
    ``budgets`` (session, at, ...) are measured requests, the newest four of each session.
    """
    U.in_ring(points).createOrReplaceTempView("plan_history")
    executed(done).createOrReplaceTempView("plan_executed")
    route_settings(routes, capabilities).createOrReplaceTempView("route_settings")
    B.newest(budgets, "at", 4, ["session"]).createOrReplaceTempView("request_budgets")
    if ledger is not None:
        ledger.provenance().createOrReplaceTempView("provenance")
