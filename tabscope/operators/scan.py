"""One scan, many aggregates.

Every per-column metric of the statistics, personal-data and pattern operators is
an aggregate expression.  ``FusedScan`` puts them into one global aggregate: one
scan of the table, partial aggregates per task, no data shuffled.  Sketches are
binary buffers, so the aggregate has one buffer field per sketch and stays small
for wide tables; a CSV or a derived view is parsed or computed once, whatever its width.

Where every column can be read for itself (Parquet or ORC, projected and filtered at most), a wide scan runs as several
of some columns each: what Spark generates for hundreds of aggregates is too long to be compiled, and costs many times as much a column.

The one wide result row becomes long form (one row per column, or per column and
pattern): with ``inline(array(struct(...)))`` as long as nothing has run, and as plain rows
of a local relation once the row has been fetched.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.exprs import sql_id, sql_str
from ..functions.families import ColumnSpec
from ..functions.frames import local_rows, schema_of

ROWS = "_rows"
_CORRUPT = "_corrupt_rows"
#: Most aggregates of a scan where columns can be read apart: those that Spark generates code for, extremes of texts and
#: sketches, for which it generates none and which would keep it from doing so for others.  And the scans that run at once.
PLAIN, TEXT, SKETCH = "plain", "text", "sketch"
GROUP = {PLAIN: 40, TEXT: 12, SKETCH: 10}
AT_ONCE = 4


@dataclass(frozen=True)
class Ref:
    """A metric in a long form's row: of the row's column, or (without a column) the table's row count."""

    key: str
    spec: ColumnSpec | None = None


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return sql_str(value) if isinstance(value, str) else str(value)


def alias(spec: ColumnSpec, key: str) -> str:
    return f"c{spec.ordinal}__{key}"


def reads_columns_apart(df: DataFrame) -> bool:
    """Does a scan of some columns read no others, and compute nothing for them?"""
    def apart(plan) -> bool:
        name = plan.nodeName()
        if name == "LogicalRelation":
            return plan.simpleString(1).rsplit(" ", 1)[-1] in ("parquet", "orc")
        children = plan.children()
        return name in ("Project", "Filter") and apart(children.head())

    return apart(df._jdf.queryExecution().optimizedPlan())


def in_groups(items: Iterable, most: int, weight: Callable[[object], int] = lambda _: 1) -> list[list]:
    """The items in order, in lists that together weigh ``most`` at the most; one that weighs more is alone."""
    groups, held = [], 0
    for item in items:
        w = weight(item)
        if not groups or held + w > most:
            groups.append([])
            held = 0
        groups[-1].append(item)
        held += w
    return groups


def at_once(run: Callable, groups: list) -> list:
    """The results of ``run`` over groups of columns (or their scans), a few at a time."""
    if len(groups) < 2:
        return [run(g) for g in groups]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(run, groups))


class FusedScan:
    """Aggregates of many operators over one table, evaluated in one scan."""

    def __init__(self, df: DataFrame, specs: Iterable[ColumnSpec]):
        self.df = df
        self.specs = list(specs)
        self._exprs: dict[str, str] = {}
        self._kinds: dict[str, str] = {}
        self._values: dict[str, object] | None = None

    def add(self, spec: ColumnSpec, key: str, expr: str, kind: str = PLAIN) -> None:
        """Register an aggregate, written as SQL text over the table's columns; ``kind``: see ``GROUP``."""
        self._exprs.setdefault(alias(spec, key), expr)
        self._kinds.setdefault(alias(spec, key), kind)

    def count_corrupt(self, column: str) -> None:
        """Count the rows that the reader marked as not fitting the declared schema."""
        self._exprs.setdefault(_CORRUPT, f"count({sql_id(column)})")
        self._kinds.setdefault(_CORRUPT, PLAIN)

    @property
    def corrupt(self) -> int:
        return self.collect()._values.get(_CORRUPT) or 0

    @property
    def is_empty(self) -> bool:
        return not self._exprs

    def aggregate(self) -> DataFrame:
        """The one-row aggregate, not run yet."""
        return self._part(self._exprs)

    def _part(self, names: Iterable[str]) -> DataFrame:
        """The one-row aggregate of some metrics, and of the rows."""
        return self.df.selectExpr(f"count(1) AS {ROWS}", *[f"{self._exprs[a]} AS {a}" for a in names])

    def _columns(self, names: Iterable[str], most: int) -> list[list[str]]:
        """Metrics in groups of whole columns."""
        of: dict[str, list[str]] = {}
        for a in names:
            of.setdefault(a.partition("__")[0], []).append(a)
        return [[a for own in group for a in own] for group in in_groups(of.values(), most, len)]

    def collect(self) -> "FusedScan":
        """Run the scan now and keep its row, whose size the schema sets."""
        if self._values is None:
            if len(self._exprs) <= GROUP[PLAIN] or not reads_columns_apart(self.df):
                frames = [self.aggregate()]
            else:
                frames = [self._part(g) for kind, most in GROUP.items() for g in self._columns((a for a, k in self._kinds.items() if k == kind), most)]
            values = {}
            for row in at_once(lambda frame: frame.first().asDict(), frames):
                values.update(row)
            self._values = values
        return self

    def adopt(self, others: Iterable["FusedScan"]) -> "FusedScan":
        """Take the rows of other scans of the same table instead of scanning."""
        self._values = {}
        for o in others:
            self._values.update(o._values)
        return self

    def put(self, spec: ColumnSpec, key: str, value) -> None:
        """Add a result computed by a later pass."""
        self.collect()._values[alias(spec, key)] = value

    def get(self, spec: ColumnSpec, key: str):
        return self.collect()._values.get(alias(spec, key))

    @property
    def rows(self) -> int:
        return self.collect()._values.get(ROWS) or 0

    def long(self, specs: Iterable[ColumnSpec], build: Callable[[ColumnSpec], list[tuple]], schema: str) -> DataFrame:
        """Long form: ``build(spec)`` gives rows of values and :class:`Ref` in the order of ``schema``; a metric that
        there isn't is null.  Lazy, if the scan hasn't run; else a local relation."""
        if self._values is not None:
            return local_rows(self.df.sparkSession, self.rows_of(specs, build), schema)
        fields = schema_of(schema).fields
        known = set(self._exprs) | {ROWS}
        own: dict[str, int] = {}
        for a in self._exprs:
            column = a.partition("__")[0]
            own[column] = own.get(column, 0) + 1

        def struct(values: tuple) -> str:
            names = [(alias(v.spec, v.key) if v.spec else v.key) if isinstance(v, Ref) else None for v in values]
            cells = [(n if n in known else "NULL") if n else _literal(v) for n, v in zip(names, values)]
            items = ", ".join(f"{sql_str(f.name)}, CAST({c} AS {f.dataType.simpleString()})" for f, c in zip(fields, cells))
            return f"named_struct({items})"

        columns = [(f"c{s.ordinal}", rows) for s in specs if (rows := [struct(values) for values in build(s)])]
        if not columns:
            return local_rows(self.df.sparkSession, [], schema)
        groups = [columns]
        if len(self._exprs) > GROUP[PLAIN] and reads_columns_apart(self.df):
            groups = in_groups(columns, GROUP[PLAIN], lambda c: own.get(c[0], 0))
        parts = []
        for group in groups:
            own_columns = {c for c, _ in group}
            frame = self.aggregate() if len(groups) == 1 else self._part([a for a in self._exprs if a.partition("__")[0] in own_columns])
            parts.append(frame.selectExpr(f"inline(array({', '.join(r for _, rows in group for r in rows)}))"))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def rows_of(self, specs: Iterable[ColumnSpec], build: Callable[[ColumnSpec], list[tuple]]) -> list[tuple]:
        """The rows of :meth:`long`, from the fetched row."""
        self.collect()

        def value(v):
            if not isinstance(v, Ref):
                return v
            return self.get(v.spec, v.key) if v.spec else self.rows

        return [tuple(value(v) for v in values) for s in specs for values in build(s)]
