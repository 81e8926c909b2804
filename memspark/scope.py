"""Scopes: the paths global, project:<id> and tenant:<id>, and filters over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("global", "project", "tenant")


@dataclass(frozen=True)
class ScopeFilter:
    """What to include; include_all_projects takes precedence over one project."""

    project: str | None = None
    tenant: str | None = None
    include_global: bool = True
    all_projects: bool = False

    def column(self, name: str = "scope") -> Column:
        """The predicate; with nothing included, false. A null scope gives null, which no filter passes: so it reaches the scan."""
        c, parts = F.col(name), []
        if self.all_projects:
            parts.append(c.startswith("project:"))
        elif self.project is not None:
            parts.append(c == f"project:{self.project}")
        if self.tenant is not None:
            parts.append(c == f"tenant:{self.tenant}")
        if self.include_global:
            parts.append(c == "global")
        return reduce(Column.__or__, parts) if parts else F.lit(False)


def project_scope(project: str, include_global: bool = True) -> ScopeFilter:
    return ScopeFilter(project=project, include_global=include_global)


def cross_project_scope(include_global: bool = True) -> ScopeFilter:
    return ScopeFilter(all_projects=True, include_global=include_global)


def global_only_scope() -> ScopeFilter:
    return ScopeFilter()


def tenant_scope(tenant: str, include_global: bool = True) -> ScopeFilter:
    return ScopeFilter(tenant=tenant, include_global=include_global)


def scope_path(kind: str, name: str | None = None) -> str:
    """global, or kind:name."""
    if kind not in KINDS or (kind == "global") != (name is None):
        raise ValueError(f"no scope: {kind!r}, {name!r}")
    return kind if name is None else f"{kind}:{name}"


def parse_scope(c: Column) -> Column:
    """struct(kind, name) of a scope path; nulls if it is none."""
    kind = F.split_part(c, F.lit(":"), F.lit(1))
    good = (c == "global") | c.rlike(r"^(?:project|tenant):.")
    name = F.when(c != "global", F.substr(c, F.length(kind) + 2))
    return F.struct(F.when(good, kind).alias("kind"), F.when(good, name).alias("name"))
