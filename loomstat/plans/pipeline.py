"""Pipelines, feature unions and graphs of stages; each composes into one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomstat.errors import InvalidParameter


class Pipeline:
    """Stages in order; fit() fits each on what those before it give."""

    def __init__(self, *stages):
        if not stages:
            raise InvalidParameter("a pipeline needs a stage")
        self.stages = stages

    def fit(self, df: DataFrame) -> "PipelineModel":
        models = []
        for i, s in enumerate(self.stages):
            models.append(s.fit(df))
            if i + 1 < len(self.stages):
                df = models[-1].transform(df)
        return PipelineModel(models)

    def copy(self, **changes) -> "Pipeline":
        """changes: stage index and parameter, as s0__alpha."""
        own: dict[int, dict] = {}
        for name, value in changes.items():
            stage, _, param = name.partition("__")
            own.setdefault(int(stage[1:]), {})[param] = value
        return Pipeline(*[s.copy(**own.get(i, {})) for i, s in enumerate(self.stages)])

    def fit_stream(self, batches) -> "PipelineModel":
        """Stages with update() are fitted on one batch after another; a one-pass source serves one stage only."""
        batches, models = list(batches), []
        for s in self.stages:
            model = None
            for b in batches:
                for m in models:
                    b = m.transform(b)
                model = s.fit(b) if model is None else (s.update(model, b) if hasattr(s, "update") else model.update(b))
            models.append(model)
        return PipelineModel(models)


class PipelineModel:
    def __init__(self, models):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        for m in self.models:
            df = m.transform(df)
        return df


class FeatureUnion:
    """Members see the same input; their columns come in the members' order, without a join."""

    def __init__(self, *members):
        self.members = members

    def fit(self, df: DataFrame) -> "FeatureUnionModel":
        return FeatureUnionModel([m.fit(df) for m in self.members])


class FeatureUnionModel:
    def __init__(self, models):
        self.models = models

    def columns(self) -> dict:
        out: dict = {}
        for m in self.models:
            for name, column in m.columns().items():
                if name in out:
                    raise InvalidParameter(f"two members make {name}")
                out[name] = column
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


class Graph:
    """Named nodes, each with a stage and the nodes that it reads; nodes without any read the input.

    A node sees the columns of all that it reads. One node, the last, is read by none."""

    def __init__(self):
        self.nodes: dict[str, tuple[object, tuple[str, ...]]] = {}

    def add(self, name: str, stage, *reads: str) -> "Graph":
        if name in self.nodes:
            raise InvalidParameter(f"node {name} twice")
        self.nodes[name] = (stage, reads)
        return self

    def order(self) -> list[str]:
        """By level, then by name."""
        level: dict[str, int] = {}

        def depth(name: str, path: tuple[str, ...]) -> int:
            if name in path:
                raise InvalidParameter(f"cycle through {name}")
            if name not in self.nodes:
                raise InvalidParameter(f"no node {name}")
            if name not in level:
                level[name] = 1 + max((depth(r, (*path, name)) for r in self.nodes[name][1]), default=-1)
            return level[name]

        for name in self.nodes:
            depth(name, ())
        read = {r for _, reads in self.nodes.values() for r in reads}
        if len(last := [n for n in self.nodes if n not in read]) != 1:
            raise InvalidParameter(f"one final node is needed, not {last}")
        return sorted(self.nodes, key=lambda n: (level[n], n))

    def fit(self, df: DataFrame) -> PipelineModel:
        models = []
        for name in self.order():
            m = self.nodes[name][0].fit(df)
            models.append(m)
            df = m.transform(df)
        return PipelineModel(models)
