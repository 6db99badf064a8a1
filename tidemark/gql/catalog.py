"""The GraphQL schema that follows from table schemas, and its SDL."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import GraphQLError
from ..schema import TableSchema

#: Scalar names of the column types.
SCALARS = {"Boolean": "Boolean", "Int32": "Int", "Int64": "Long", "Float64": "Float", "String": "String", "DateTime": "DateTime", "Bytes": "Bytes", "Jsonb": "JSON"}
ORDERED = ("eq", "ne", "in", "notIn", "gt", "gte", "lt", "lte", "between", "isNull")
FILTERS = {
    "Boolean": ("eq", "ne", "in", "notIn", "isNull"),
    "Int": ORDERED,
    "Long": ORDERED,
    "Float": ORDERED,
    "String": (*ORDERED, "like"),
    "DateTime": ORDERED,
    "Bytes": ("eq", "ne", "isNull"),
}


@dataclass(frozen=True)
class Relation:
    """``forward``: to the one parent row; else to the list of child rows."""

    name: str
    forward: bool
    table: str
    own_column: str
    other_column: str


def type_name(table: str) -> str:
    return "".join(part[:1].upper() + part[1:] for part in table.split("_"))


class Catalog:
    def __init__(self, schemas: dict[str, TableSchema]):
        self.schemas = schemas
        self.relations: dict[str, dict[str, Relation]] = {}
        for name, schema in schemas.items():
            used, found = set(schema.names), {}

            def add(base, used=used, found=found, **parts):
                own, n = base, 1
                while own in used:
                    own, n = f"{base}_rel{n if n > 1 else ''}", n + 1
                used.add(own)
                found[own] = Relation(own, **parts)

            for fk in schema.foreign_keys:
                if fk.parent_table in schemas:
                    add(fk.forward_name or fk.parent_table, forward=True, table=fk.parent_table, own_column=fk.column, other_column=fk.parent_column)
            for other in schemas.values():
                for fk in other.foreign_keys:
                    if fk.parent_table == name:
                        add(fk.reverse_name or other.name, forward=False, table=other.name, own_column=fk.parent_column, other_column=fk.column)
            self.relations[name] = found
        self.roots = {"query": {}, "mutation": {}}
        for name, schema in schemas.items():
            self.roots["query"][name] = ("list", name)
            if schema.primary_key:
                self.roots["query"][f"{name}ByPk"] = ("one", name)
            for verb in ("insert", "update", "delete"):
                self.roots["mutation"][f"{verb}{type_name(name)}"] = (verb, name)
        self.roots["subscription"] = self.roots["query"]

    def root(self, kind: str, name: str) -> tuple[str, str]:
        try:
            return self.roots[kind][name]
        except KeyError:
            raise GraphQLError(f"unknown {kind} field {name}") from None

    def sdl(self) -> str:
        out = [f"scalar {s}" for s in ("Bytes", "DateTime", "JSON", "Long")]
        out.append(_block("enum", "SortDirection", ["ASC", "DESC"]))
        for name, schema in self.schemas.items():
            t = type_name(name)
            kinds = {c.name: SCALARS[c.type] for c in schema.columns}
            out.append(_block("enum", f"{t}OrderField", [c.upper() for c in schema.names]))
            fields = [f"{c.name}: {kinds[c.name]}{'' if c.nullable else '!'}" for c in schema.columns]
            for r in self.relations[name].values():
                other = type_name(r.table)
                fields.append(f"{r.name}: {other}" if r.forward else f"{r.name}{self._page(r.table)}: [{other}!]!")
            out.append(_block("type", t, fields))
            out.append(_block("input", f"{t}WhereInput", [f"AND: [{t}WhereInput!]", f"OR: [{t}WhereInput!]", *[f"{c}: {k}Filter" for c, k in kinds.items()]]))
            out.append(_block("input", f"{t}OrderByInput", [f"field: {t}OrderField!", "direction: SortDirection"]))
            out.append(_block("input", f"{t}InsertInput", [f"{c.name}: {kinds[c.name]}{'' if c.nullable else '!'}" for c in schema.columns]))
            out.append(_block("input", f"{t}PatchInput", [f"{c}: {k}" for c, k in kinds.items()]))
            if schema.primary_key:
                out.append(_block("input", f"{t}PkInput", [f"{c}: {kinds[c]}!" for c in schema.primary_key]))
        for scalar, ops in FILTERS.items():
            kinds = {"in": f"[{scalar}!]", "notIn": f"[{scalar}!]", "between": f"[{scalar}!]", "isNull": "Boolean"}
            out.append(_block("input", f"{scalar}Filter", [f"{op}: {kinds.get(op, scalar)}" for op in ops]))
        out.append(_block("input", "JSONFilter", ["path: String", "eq: JSON", "contains: JSON", "exists: Boolean", "isNull: Boolean"]))
        reads = [line for name in self.schemas for line in self._reads(name)]
        out += [_block("type", "Query", reads), _block("type", "Mutation", [line for name in self.schemas for line in self._writes(name)]), _block("type", "Subscription", reads)]
        return "\n\n".join(out) + "\n"

    def _page(self, table: str) -> str:
        t = type_name(table)
        return f"(where: {t}WhereInput, orderBy: [{t}OrderByInput!], limit: Int, offset: Int)"

    def _reads(self, name: str) -> list[str]:
        t = type_name(name)
        out = [f"{name}{self._page(name)}: [{t}!]!"]
        return out + [f"{name}ByPk(pk: {t}PkInput!): {t}"] if self.schemas[name].primary_key else out

    def _writes(self, name: str) -> list[str]:
        t, page = type_name(name), self._page(name)[1:-1]
        return [f"insert{t}(input: [{t}InsertInput!]!): [{t}!]!", f"update{t}({page}, set: {t}PatchInput!): [{t}!]!", f"delete{t}({page}): [{t}!]!"]


def _block(kind: str, name: str, lines: list[str]) -> str:
    return f"{kind} {name} {{\n" + "".join(f"  {line}\n" for line in lines) + "}"
