"""The model of packages: flows are graphs of nodes, each with options and named inputs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import FlowError


@dataclass
class Node:
    """``inputs`` are (input name, "node.port"); the default port is "out"."""

    name: str
    kind: str
    options: dict[str, Any] = field(default_factory=dict)
    inputs: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Flow:
    name: str = "flow"
    nodes: dict[str, Node] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def add(self, name: str, kind: str, *inputs: str, named: dict[str, str] | None = None, **options: Any) -> Flow:
        """Add a node that reads ``inputs`` ("node" or "node.port"); returns the flow."""
        if name in self.nodes:
            raise FlowError(f"two nodes are named {name!r}")
        found = [(f"in{k}", x) for k, x in enumerate(inputs)] + list((named or {}).items())
        self.nodes[name] = Node(name, kind, options, [(n, x if "." in x else f"{x}.out") for n, x in found])
        return self

    def order(self) -> list[Node]:
        """Nodes after their inputs; in a cycle, the order of declaration, with a warning."""
        names = list(self.nodes)
        waiting = {n: {x.rsplit(".", 1)[0] for _, x in self.nodes[n].inputs} & set(names) for n in names}
        out: list[str] = []
        while len(out) < len(names):
            ready = [n for n in names if n not in out and waiting[n] <= set(out)]
            if not ready:
                self.warnings.append(f"{self.name}: the graph has a cycle; nodes run as declared")
                ready = [n for n in names if n not in out]
                out += ready
                break
            out.append(ready[0])
        return [self.nodes[n] for n in out]


@dataclass
class Project:
    """What the packages of a folder share: typed parameters and connections."""

    name: str
    protection: str = ""
    packages: list[str] = field(default_factory=list)
    parameters: dict[tuple[str, str], tuple[str | None, str]] = field(default_factory=dict)
    connections: dict[str, dict[str, Any]] = field(default_factory=dict)
    sensitive: set[tuple[str, str]] = field(default_factory=set)


@dataclass
class Package:
    """Flows in order, with typed variables: (namespace, name) to (text, type code), and calls of other packages."""

    name: str
    flows: list[Flow] = field(default_factory=list)
    variables: dict[tuple[str, str], tuple[str | None, str]] = field(default_factory=dict)
    connections: dict[str, dict[str, Any]] = field(default_factory=dict)
    project_connections: dict[str, dict[str, Any]] = field(default_factory=dict)
    calls: dict[str, str] = field(default_factory=dict)  # task to package file
    precedence: list[tuple[str, str, str]] = field(default_factory=list)  # before, after, success | completion | failure
    statements: list[str] = field(default_factory=list)
    sensitive: set[tuple[str, str]] = field(default_factory=set)
