"""GOLD build graph: every published view with its inputs, group and builder, built in topological order.

Shared nodes (the silver bill, findings) are built once, stored in the shared work folder and read by every view
that needs them; views stay lazy until publication writes them. Asking for some views builds only them and
what they depend on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sinks import lake
from tallyspark.sinks.files import stored

BY_PROVIDER = "by_provider"


@dataclass(frozen=True)
class Node:
    """A node of the graph. `group`: None for a shared node, BY_PROVIDER for a view split by provider, else the
    fixed group it is published in. `build` takes the built inputs in the order of `inputs`."""

    name: str
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    group: str | None = None
    dimensions: tuple[str, ...] = field(default=(), compare=False)
    measures: tuple[str, ...] = field(default=(), compare=False)


def ordered(nodes: Iterable[Node], wanted: Iterable[str] | None = None) -> list[Node]:
    """The nodes that `wanted` (all views when None) needs, each after its inputs; ties by name.

    An unknown input, a name used twice or a cycle is an error.
    """
    by_name: dict[str, Node] = {}
    for node in nodes:
        if node.name in by_name:
            raise ValueError(f"node {node.name} defined twice")
        by_name[node.name] = node
    for node in by_name.values():
        for name in node.inputs:
            if name not in by_name:
                raise ValueError(f"{node.name} needs unknown node {name}")
    goals = sorted(n.name for n in by_name.values() if n.group is not None) if wanted is None else list(wanted)
    out: list[Node] = []
    state: dict[str, str] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name not in by_name:
            raise ValueError(f"unknown node {name}")
        if state.get(name) == "done":
            return
        if state.get(name) == "open":
            raise ValueError(f"cycle: {' -> '.join((*path, name))}")
        state[name] = "open"
        for source in sorted(by_name[name].inputs):
            visit(source, (*path, name))
        state[name] = "done"
        out.append(by_name[name])

    for goal in goals:
        visit(goal, ())
    return out


def build(nodes: Iterable[Node], wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Frames of the wanted views and all they need; shared nodes are stored once and read back."""
    built: dict[str, DataFrame] = {}
    for node in ordered(nodes, wanted):
        frame = node.build(*(built[name] for name in node.inputs))
        built[node.name] = stored(frame, f"gold-{node.name}") if node.group is None else frame
    return built


def publish(
    spark: SparkSession, root: str, nodes: Iterable[Node], wanted: Iterable[str] | None = None,
    built: dict[str, DataFrame] | None = None,
) -> list[str]:
    """Builds the wanted views (all without a choice) and publishes them as '<group>/<view>' under `root`.

    Views split by provider go to one folder per provider group; the others to their fixed group. Returns the
    published relations. Frames from an earlier `build` of the same nodes may be passed in `built`.
    """
    nodes = list(nodes)
    built = built if built is not None else build(nodes, wanted)
    views = [n for n in ordered(nodes, wanted) if n.group is not None]
    split = {n.name: built[n.name] for n in views if n.group == BY_PROVIDER}
    fixed: dict[str, dict[str, DataFrame]] = {}
    for n in views:
        if n.group != BY_PROVIDER:
            fixed.setdefault(n.group, {})[n.name] = built[n.name]
    return lake.publish_gold(spark, root, split, fixed)


def catalog_rows(nodes: Iterable[Node]) -> list[tuple]:
    """(view, group, inputs, dimensions, measures) of every view, in build order."""
    return [(n.name, n.group, list(n.inputs), list(n.dimensions), list(n.measures)) for n in ordered(nodes) if n.group is not None]
