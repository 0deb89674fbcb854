"""SQL models: each a table defined by one SELECT over others."""

from __future__ import annotations

from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from tableops.operators.tables import overwrite_table


@dataclass(frozen=True)
class Model:
    """Table ``name`` is ``select``, in which ``{other}`` stands for a model or
    source named in ``depends_on``. An ``optional`` model may fail."""

    name: str
    select: str
    depends_on: tuple[str, ...] = ()
    optional: bool = False


class ModelError(RuntimeError):
    """A model that had to succeed did not; ``report`` says what happened to all."""

    def __init__(self, report: list[tuple[str, str, str | None]]):
        bad = [f"{name}: {status} ({error})" for name, status, error in report if status != "built"]
        super().__init__("; ".join(bad))
        self.report = report


def refresh_models(
    spark: SparkSession,
    models: list[Model],
    db: str,
    sources: dict[str, DataFrame] | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Rebuild every model as ``db.<name>``, dependencies first.

    Models that do not wait for one another are built side by side, ``at_once`` at most,
    each in a scheduler pool of its own, so that with ``spark.scheduler.mode`` FAIR a
    long one does not hold the others up. A model begins as soon as those it depends on are
    built.

    A model whose upstream was not built is skipped, and the others go on. The
    result is ``model, status, error``, dependencies first. If a model that is not optional failed or
    was skipped, ``ModelError`` is raised after the last one.
    """
    sources = sources or {}
    by_name = {m.name: m for m in models}
    unknown = {d for m in models for d in m.depends_on} - by_name.keys() - sources.keys()
    if unknown:
        raise ValueError(f"neither models nor sources: {sorted(unknown)}")
    graph = {m.name: [d for d in m.depends_on if d in by_name] for m in models}
    order = list(TopologicalSorter(graph).static_order())
    outcome: dict[str, tuple[str, str | None]] = {}

    def build(model: Model) -> tuple[str, str | None]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"model-{model.name}")
        try:
            upstream = {
                d: spark.table(f"{db}.{d}") if d in by_name else sources[d] for d in model.depends_on
            }
            overwrite_table(spark.sql(model.select, **upstream), f"{db}.{model.name}")
            return "built", None
        except Exception as e:
            return "failed", str(e)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    waiting = TopologicalSorter(graph)
    waiting.prepare()
    running: dict[Future, str] = {}
    with ThreadPoolExecutor(at_once) as pool:
        while waiting.is_active():
            for name in waiting.get_ready():
                missing = [d for d in graph[name] if outcome[d][0] != "built"]
                if missing:
                    outcome[name] = "skipped", f"not built: {', '.join(missing)}"
                    waiting.done(name)
                else:
                    running[pool.submit(build, by_name[name])] = name
            if running:
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(future)
                    outcome[name] = future.result()
                    waiting.done(name)
    report = [(name, *outcome[name]) for name in order]
    if any(outcome[m.name][0] != "built" and not m.optional for m in models):
        raise ModelError(report)
    return spark.createDataFrame(report, "model string, status string, error string")


def run_statements(
    spark: SparkSession, statements: list[str], context: str = "spark"
) -> DataFrame | None:
    """Run SQL statements one after the other; the last one's result.

    Blank ones and those that are one comment line are passed over. ``context``
    is ``spark`` or ``hive``; the second asks for a session with Hive support.
    """
    if context not in ("spark", "hive"):
        raise NotImplementedError(f"no context {context!r}")
    if context == "hive" and spark.conf.get("spark.sql.catalogImplementation") != "hive":
        raise ValueError("the session has no Hive support")
    result = None
    for statement in statements:
        text = statement.strip()
        if text and not (text.startswith("--") and "\n" not in text):
            result = spark.sql(text)
    return result


def adhoc_query(spark: SparkSession, sql: str | None) -> DataFrame:
    """The result of one query, which must not be empty."""
    if not sql or not sql.strip():
        raise ValueError("a query is needed")
    return spark.sql(sql)

