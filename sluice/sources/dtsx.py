"""Package files to flows: the XML of ``.dtsx`` packages, project parameters, and folders of packages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import types as T

from ..errors import PackageError
from ..plans.flow import Flow, Package, Project
from ..types import spark_type

# How components of the package format are named, longest first where one name holds another.
KINDS = {
    "derivedcolumn": "derived_column", "dataconvert": "data_conversion", "dataconversion": "data_conversion", "copymap": "copy_column", "copycolumn": "copy_column",
    "conditionalsplit": "conditional_split", "mergejoin": "merge_join", "unionall": "union_all", "multicast": "multicast", "rowcount": "row_count",
    "aggregate": "aggregate", "lookup": "lookup", "sort": "sort", "merge": "merge", "lineage": "audit", "audit": "audit", "charactermap": "character_map",
    "unpivot": "unpivot", "pivot": "pivot", "scripthost": "script", "scriptcomponent": "script", "slowlychangingdimension": "slowly_changing_dimension", "oledbcommand": "oledb_command",
    "flatfilesource": "flat_source", "flatfiledestination": "destination", "destination": "destination", "source": "source",
}
# Components of the oldest packages are known by an identifier only.
IDENTIFIERS = {
    "2c0a8be5-1edc-4353-a0ef-b778599c65a0": "source", "b551fca8-23bd-4719-896f-d8f352a5283c": "source",
    "e2568105-9550-4f71-a638-b7fe42e66922": "destination", "4963caed-cb38-4146-96f0-5910342ff3b9": "destination",
    "9cf90bf0-5bcc-4c63-b91d-1f322dc12c26": "derived_column",
}
# Codes of aggregations and of audit columns.
AGGREGATES = {"0": "by", "1": "count", "2": "count_distinct", "3": "sum", "4": "avg", "5": "max", "6": "min"}
# Type numbers of flat-file columns.
NUMBERED = {"2": "i2", "3": "i4", "4": "r4", "5": "r8", "6": "cy", "7": "date", "11": "bool", "14": "decimal", "16": "i1", "17": "ui1", "18": "ui2", "19": "ui4", "20": "i8", "21": "ui8", "129": "str", "130": "wstr", "131": "numeric", "133": "dbdate", "135": "dbtimestamp"}
AUDITS = {"0": "execution_id", "1": "package_id", "2": "package_name", "3": "version_id", "4": "start_time", "5": "machine", "6": "user", "7": "task_name", "8": "task_id"}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2].lower() == name.lower()), default)


def _all(e: ET.Element, name: str):
    return (x for x in e.iter() if _local(x) == name)


def _children(e: ET.Element, *path: str) -> list[ET.Element]:
    level = [e]
    for name in path:
        level = [x for y in level for x in y if _local(x) == name]
    return level


def _properties(e: ET.Element) -> dict[str, str]:
    return {_attr(p, "name").lower(): (p.text or "").strip() for p in _children(e, "properties", "property")}


def kind_of(class_id: str) -> str:
    known = IDENTIFIERS.get(class_id.strip().lower().split(",")[0].strip("{} "))
    if known:
        return known
    name = re.sub(r"[^a-z]", "", class_id.lower().split(",")[0])
    return next((kind for word, kind in KINDS.items() if word in name), "unknown")


def _flag(e: ET.Element, name: str) -> bool:
    return _attr(e, name).lower() in ("true", "1", "-1")


def _missing(port: str) -> bool:
    return "no match" in re.sub("[_-]", " ", port.lower())


def _manager(e: ET.Element) -> dict:
    """A connection manager: identifiers, the pairs of its connection string, and for flat files path, header, sep, quote and schema."""
    text = next((_attr(x, "ConnectionString") for x in e.iter() if _attr(x, "ConnectionString")), "")
    out: dict = dict(x.split("=", 1) for x in text.split(";") if "=" in x)
    out = {k.strip(): v.strip() for k, v in out.items()}
    out["database"] = out.get("Initial Catalog") or out.get("Database") or ""
    out["ids"] = [x for x in (_attr(e, "refId"), _attr(e, "DTSID")) if x]
    if not out["database"] and (_attr(e, "CreationName").upper() in ("FLATFILE", "") and "=" not in text):
        out["path"] = text
    columns = list(_all(e, "FlatFileColumn"))
    if columns:
        inner = next((x for x in e.iter() if x is not e and _local(x) == "ConnectionManager"), e)
        delimiter = _unescaped(_attr(columns[0], "ColumnDelimiter")) if len(columns) > 1 else ","
        quote = _unescaped(_attr(inner, "TextQualifier"))
        out |= {"path": text, "header": _flag(inner, "ColumnNamesInFirstDataRow"), "sep": delimiter or ",", "quote": "" if quote.lower() in ("", "<none>") else quote}
        number = lambda x, k: int(_attr(x, k) or 0)
        types = [spark_type(NUMBERED.get(_attr(x, "DataType"), "wstr"), number(x, "DataPrecision") or None, number(x, "DataScale")) for x in columns]
        out["schema"] = T.StructType([T.StructField(_attr(x, "ObjectName"), t) for x, t in zip(columns, types, strict=True)])
    return out


def _unescaped(text: str) -> str:
    """Characters written as _x0022_ and the like."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


class _Flow:
    """One data-flow task: ports and columns by reference, then nodes."""

    def __init__(self, task: ET.Element, name: str, package: Package):
        self.flow, self.package = Flow(name), package
        self.components = list(_all(task, "component"))
        self.name_of = {_attr(c, "refId") or _attr(c, "id"): _attr(c, "name") for c in self.components}
        self.column = {}  # lineage to column name
        self.port = {}  # reference of an output or input to (component, port name)
        for c in self.components:
            for side in ("output", "input"):
                for p in _children(c, f"{side}s", side):
                    self.port[_attr(p, "refId") or _attr(p, "id")] = (_attr(c, "name"), _attr(p, "name"))
                    for x in _children(p, f"{side}Columns", f"{side}Column"):
                        for key in ("lineageId", "refId", "id"):
                            if side == "output" and _attr(x, key):
                                self.column.setdefault(_attr(x, key), _attr(x, "name"))
        self.feeds = {}
        for p in _all(task, "path"):
            self.feeds[_attr(p, "endId")] = _attr(p, "startId")
        for c in self.components:
            self.node(c)

    def reference(self, text: str) -> str:
        text = re.sub(r"^#?\{(.*)\}$", r"\1", text.strip()).lstrip("#")
        return self.column.get(text, re.sub(r".*\[(.*)\]$", r"\1", text))

    def inputs(self, c: ET.Element) -> dict[str, str]:
        out = {}
        for p in _children(c, "inputs", "input"):
            start = self.port.get(self.feeds.get(_attr(p, "refId") or _attr(p, "id"), ""))
            if start:
                out[_attr(p, "name")] = f"{start[0]}.{self.named_port(start[0], start[1])}"
        return out

    def named_port(self, component: str, port: str) -> str:
        c = next(x for x in self.components if _attr(x, "name") == component)
        kind = kind_of(_attr(c, "componentClassID"))
        outs = _children(c, "outputs", "output")
        if any(_attr(x, "name") == port and _flag(x, "isErrorOut") for x in outs):
            return "error"
        if kind == "lookup":
            # An output for rows without a match counts as such only beside one for matches.
            missing = [_missing(_attr(x, "name")) for x in outs if not _flag(x, "isErrorOut")]
            return "nomatch" if _missing(port) and not all(missing) else "match"
        return port if kind in ("conditional_split", "multicast") else "out"

    def connection(self, c: ET.Element) -> dict:
        """The connection manager of a component: of the package first, then of the project; by reference or identifier, then by name."""
        uses = list(_all(c, "connection"))
        for key in ("ids", "name"):
            for x in uses:
                wanted = {_attr(x, "connectionManagerRefId"), _attr(x, "connectionManagerID").split(":")[0], *([_attr(x, "name")] if key == "name" else [])} - {""}
                wanted |= {re.sub(r".*\[(.*)\]$", r"\1", w) for w in wanted} if key == "name" else set()
                for scope in (self.package.connections, self.package.project_connections):
                    for name, manager in scope.items():
                        if (wanted & set(manager.get("ids", ())) if key == "ids" else name in wanted):
                            return manager
        return {}

    @staticmethod
    def typed(x: ET.Element) -> tuple:
        number = lambda k: int(_attr(x, k) or 0) or None
        return _attr(x, "dataType"), number("length"), number("precision"), number("scale")

    def node(self, c: ET.Element) -> None:
        kind, o, name = kind_of(_attr(c, "componentClassID")), {}, _attr(c, "name")
        p, ins = _properties(c), self.inputs(c)
        outs = [x for x in _children(c, "outputs", "output") if not _flag(x, "isErrorOut")]
        manager = self.connection(c)
        columns = [x for out in outs for x in _children(out, "outputColumns", "outputColumn")]
        props = {id(x): _properties(x) for x in columns}
        read = [x for i in _children(c, "inputs", "input") for x in _children(i, "inputColumns", "inputColumn")]
        if kind in ("source", "flat_source"):
            o = {"sql": p.get("sqlcommand") or None, "table": p.get("openrowset") or p.get("tablename") or None, "columns": [_attr(x, "name") for x in columns]}
            if p.get("sqlcommandvariable"):
                space, _, v = p["sqlcommandvariable"].rpartition("::")
                o["variable"] = (space or "User", v)
            if kind == "flat_source":
                o |= {k: manager[k] for k in ("path", "header", "sep", "quote", "schema") if k in manager}
            o["database"] = manager.get("database", "")
        elif kind == "derived_column":
            o["expressions"] = {_attr(x, "name"): (props[id(x)].get("friendlyexpression") or props[id(x)].get("expression"), *self.typed(x)) for x in columns}
            for x in read:  # columns that are replaced
                q = _properties(x)
                if q.get("friendlyexpression") or q.get("expression"):
                    o["expressions"][self.reference(_attr(x, "lineageId"))] = q.get("friendlyexpression") or q["expression"]
        elif kind == "data_conversion":
            o["conversions"] = {_attr(x, "name"): (self.reference(props[id(x)].get("sourceinputcolumnlineageid", "")), *self.typed(x)) for x in columns}
        elif kind == "copy_column":
            o["copies"] = {_attr(x, "name"): self.reference(props[id(x)].get("copycolumnid", "")) for x in columns}
        elif kind == "audit":
            o["columns"] = {_attr(x, "name"): AUDITS.get(next((v for k, v in props[id(x)].items() if "type" in k or "lineage" in k), ""), "?") for x in columns}
        elif kind == "conditional_split":
            ranked = []
            for out in outs:
                q = _properties(out)
                text = q.get("friendlyexpression") or q.get("expression")
                if text:
                    ranked.append((int(q.get("evaluationorder") or 10**6), len(ranked), _attr(out, "name"), text))
                else:
                    o["default"] = _attr(out, "name")
            o["conditions"] = {port: text for _, _, port, text in sorted(ranked)}
        elif kind == "lookup":
            o = {"sql": p.get("sqlcommand") or None, "table": p.get("openrowset") or p.get("tablename") or None, "keys": {}, "take": {}}
            for x in read:
                q = _properties(x)
                if q.get("jointoreferencecolumn"):
                    o["keys"][self.reference(_attr(x, "lineageId"))] = q["jointoreferencecolumn"]
                if q.get("copyfromreferencecolumn"):
                    o["take"][q["copyfromreferencecolumn"]] = q["copyfromreferencecolumn"]
            o["take"] |= {_attr(x, "name"): props[id(x)].get("copyfromreferencecolumn") or _attr(x, "name") for x in columns}
            o["on_missing"] = {"0": "fail", "1": "redirect"}.get(p.get("nomatchbehavior", ""), "redirect") if any(_missing(_attr(x, "name")) for x in outs) else "fail"
        elif kind == "merge_join":
            o = {"how": int(p.get("jointype") or 2), "n_keys": int(p.get("numkeycolumns") or 0) or None, "columns": [(_attr(x, "name"), self.reference(props[id(x)].get("inputcolumnid", "")) or _attr(x, "name")) for x in columns] or None}
        elif kind == "aggregate":
            o = {"by": [], "values": {}}
            hints = {(_attr(x, "name") or _attr(x, "cachedName") or self.reference(_attr(x, "lineageId"))).lower(): _properties(x).get("aggregationtype") for x in read}
            for x in columns:
                q = props[id(x)]
                source = self.reference(q.get("aggregationcolumnid", "")) or None
                what = q["aggregationtype"] if "aggregationtype" in q else hints.get((source or "").lower())
                what = re.sub(r"\s", "", (what or "").lower())
                what = AGGREGATES.get(what, {"groupby": "by", "average": "avg", "maximum": "max", "minimum": "min", "countdistinct": "count_distinct", "countall": "count_all"}.get(what, what))
                if what == "by":
                    o["by"].append((source or _attr(x, "name"), _attr(x, "name")))
                else:
                    o["values"][_attr(x, "name")] = (what, source)
        elif kind == "sort":
            keys = []
            for x in [*columns, *read]:
                q = props.get(id(x)) or _properties(x)
                rank = int(q.get("newsortkeyposition") or q.get("sortkeyposition") or _attr(x, "sortKeyPosition") or 0)
                if rank:
                    keys.append((abs(rank), _attr(x, "name") or self.reference(_attr(x, "lineageId")), rank > 0))
            o = {"keys": list(dict.fromkeys((n, up) for _, n, up in sorted(keys))), "distinct": p.get("eliminateduplicates", "").lower() in ("true", "1", "-1", "yes")}
        elif kind in ("union_all", "merge"):
            o["columns"] = [_attr(x, "name") for x in columns] or None
            ranked = sorted((abs(int(_attr(x, "sortKeyPosition"))), _attr(x, "name"), int(_attr(x, "sortKeyPosition")) > 0) for x in columns if int(_attr(x, "sortKeyPosition") or 0))
            o["keys"] = [(n, up) for _, n, up in ranked]
        elif kind == "row_count":
            o["variable"] = p.get("variablename") or p.get("variableexpression") or name
        elif kind == "destination":
            external = {_attr(x, "refId") or _attr(x, "id"): _attr(x, "name") for x in _all(c, "externalMetadataColumn")}
            o = {"table": p.get("openrowset") or p.get("tablename") or None}
            if "flatfile" in re.sub(r"[^a-z]", "", _attr(c, "componentClassID").lower()):
                o |= {"format": "csv", **{k: manager[k] for k in ("path", "header", "sep", "quote") if k in manager}}
            o["database"] = manager.get("database", "")
            o["mapping"] = {self.reference(_attr(x, "lineageId")) or _attr(x, "cachedName"): external.get(_attr(x, "externalMetadataColumnId"), self.reference(_attr(x, "lineageId"))) for x in read} or None
        if kind == "multicast":
            o.setdefault("ports", [_attr(x, "name") for x in outs])
        parts = [c, *columns, *read]
        if any(_attr(x, k).lower() == "redirectrow" for x in parts for k in ("errorRowDisposition", "truncationRowDisposition")):
            o["on_error"] = "redirect"
        self.flow.add(name, kind, named=ins, **o)


def read_package(path: str | Path, parameters: dict[tuple[str, str], tuple[str | None, str]] | None = None) -> Package:
    """A package from a file.  Project parameters of the folder are read too; ``parameters`` come last."""
    path = Path(path)
    try:
        root = ET.fromstring(path.read_bytes())
    except (OSError, ET.ParseError) as e:
        raise PackageError(f"{path}: {e}") from e
    package = Package(_attr(root, "ObjectName") or path.stem)
    for c in _children(root, "ConnectionManagers", "ConnectionManager"):
        package.connections[_attr(c, "ObjectName")] = _manager(c)
    project = read_project(path.parent)
    package.project_connections = project.connections
    for v in _children(root, "Variables", "Variable"):
        value = next((x for x in v if _local(x) == "VariableValue"), None)
        package.variables[(_attr(v, "Namespace") or "User", _attr(v, "ObjectName"))] = ((value.text or "") if value is not None else None, _attr(value, "DataType", "18") if value is not None else "18")
    package.variables |= project.parameters
    package.sensitive |= project.sensitive
    for v in _all(root, "PackageParameter"):
        value = next((x for x in v if _attr(x, "Name") == "ParameterValue"), None)
        key = ("$Package", _attr(v, "ObjectName"))
        package.variables[key] = ((value.text or "") if value is not None else None, _attr(v, "DataType", "18"))
        if _attr(v, "Sensitive") in ("1", "True", "true"):
            package.sensitive.add(key)
    package.variables |= parameters or {}
    for e in _all(root, "Executable"):
        what = (_attr(e, "ExecutableType") + _attr(e, "CreationName")).lower()
        if "pipeline" in what:
            package.flows.append(_Flow(e, _attr(e, "ObjectName"), package).flow)
        elif "executepackage" in what:
            package.calls[_attr(e, "refId") or _attr(e, "ObjectName")] = next((x.text or "" for x in e.iter() if _local(x) == "PackageName"), "")
        elif "executesql" in what:
            package.statements += [_attr(x, "SqlStatementSource") for x in e.iter() if _attr(x, "SqlStatementSource")]
    inside = lambda task: [t for t in package.calls if t == task or t.startswith(task + "\\")]  # noqa: E731  a container orders all tasks in it
    for x in _all(root, "PrecedenceConstraint"):
        before, after, when = _attr(x, "From"), _attr(x, "To"), WHEN.get(_attr(x, "Value", "0").lower(), "success")
        package.precedence += [(a, b, when) for a in inside(before) or [before] for b in inside(after) or [after]]
    return package


WHEN = {"1": "failure", "failure": "failure", "2": "completion", "completion": "completion"}


def read_project(folder: str | Path) -> Project:
    """The project of a folder: its manifest, ``Project.params`` and ``*.conmgr`` files; sensitive parameters are marked.  All of them may be absent."""
    folder = Path(folder)
    project = Project(folder.name)

    def root(path: Path) -> ET.Element:
        try:
            return ET.fromstring(path.read_bytes())
        except (OSError, ET.ParseError) as e:
            raise PackageError(f"{path}: {e}") from e

    pairs = lambda e: {_attr(x, "Name"): (x.text or "").strip() for x in _all(e, "Property")}
    manifest = folder / "@Project.manifest"
    if manifest.exists():
        top = root(manifest)
        named = {_attr(x, "Name"): (x.text or "").strip() for p in top if _local(p) == "Properties" for x in p}
        project.name = named.get("Name") or folder.name
        project.protection = _attr(top, "ProtectionLevel") or named.get("ProtectionLevel", "")
        project.packages = [n for n in (pairs(x).get("Name") or _attr(x, "Name") for x in _all(top, "PackageInfo")) if n]
        project.packages = project.packages or [n for n in (_attr(x, "Name") for x in _all(top, "Package")) if n]
    if (path := folder / "Project.params").exists():
        for p in _all(root(path), "Parameter"):
            props = pairs(p)
            key = ("$Project", _attr(p, "Name"))
            project.parameters[key] = (props.get("Value"), props.get("DataType") or "18")
            if props.get("Sensitive", "").lower() in ("1", "true", "-1"):
                project.sensitive.add(key)
    for path in sorted(folder.glob("*.conmgr")):
        e = root(path)
        project.connections[_attr(e, "ObjectName") or path.stem] = _manager(e)
    return project


def child_file(folder: Path, name: str) -> Path | None:
    """The package file that a task names, whatever its case; never outside the folder."""
    name = unquote(name).replace("\\", "/")
    if ".." in name.split("/") or name.startswith("/"):
        return None
    stem = name.rpartition("/")[2].lower().removesuffix(".dtsx")
    return next((p for p in sorted(folder.glob("*")) if p.suffix.lower() == ".dtsx" and p.stem.lower() == stem), None)
