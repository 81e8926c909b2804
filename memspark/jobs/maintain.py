"""Runs maintenance jobs once: spark-submit memspark/jobs/maintain.py FOLDER OUT JOB...

Every job reads the tables of FOLDER and writes its result below OUT; nothing
is changed in place. Jobs are those of JOBS, `restore`, and `clone:SOURCE:TARGET`
(scopes written with = for :); a repeated name runs once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.jobs import cloning, communities, memory, quality
from memspark.tables import table

Job = Callable[[SparkSession, str, datetime], dict[str, DataFrame]]


def _consolidate(spark, folder, now):
    new, members = memory.consolidate(table(spark, folder, "temporal_fragments"))
    return {"new": new, "members": members}


def _semantic(spark, folder, now):
    t, e = table(spark, folder, "triples"), table(spark, folder, "entities")
    edges = communities.weights(t, e)
    labels = communities.communities(edges)
    return {"labels": labels, "summaries": communities.summaries(labels, edges, e)}


def _archive(spark, folder, now):
    f, t = table(spark, folder, "temporal_fragments"), table(spark, folder, "triples")
    return {f"{n}_{k}": d for n, df, c in (("fragments", f, quality.cold_fragments(f, now)), ("triples", t, quality.cold_triples(t, now))) for k, d in zip(("hot", "archive"), quality.archive(df, c, now), strict=True)}


def _restore(spark, folder, now):
    """The archived rows (tables temporal_fragments_archive and triples_archive of the folder), hot again."""
    out = {}
    for name in ("temporal_fragments", "triples"):
        hot, rest = quality.restore(table(spark, folder, name), table(spark, folder, f"{name}_archive"), F.lit(True))
        out |= {f"{name}_hot": hot, f"{name}_archive": rest}
    return out


def _promote(spark, folder, now):
    t, e = table(spark, folder, "triples"), table(spark, folder, "entities")
    new = quality.promote(t, e)
    return {"triples": new, "entities": quality.global_entities(new, e)}


def clone_job(source: str, target: str) -> Job:
    """The job that copies a scope to another."""
    return lambda s, d, now: cloning.clone({n: table(s, d, n) for n in cloning.TABLES}, source, target)


#: Fragments of a scope from which the capacity job drops the least.
CAPACITY = 10_000
JOBS: dict[str, Job] = {
    "consolidate": _consolidate,
    "forget": lambda s, d, now: {"kept": memory.forget(table(s, d, "temporal_fragments"), now).filter(F.col("verdict").isin("protected", "kept")).drop("score", "verdict")},
    "summarize": lambda s, d, now: {"new": memory.summarize(table(s, d, "temporal_fragments"))},
    "dedup": lambda s, d, now: {"groups": memory.dedup(table(s, d, "temporal_fragments"))},
    "semantic": _semantic,
    "archive": _archive,
    "contradictions": lambda s, d, now: {"kinds": quality.contradictions(table(s, d, "triples")), "temporal": quality.temporal_contradictions(table(s, d, "triples")), "inverse": quality.inverse_causes(table(s, d, "triples"))},
    "promote": _promote,
    "capacity": lambda s, d, now: {"dropped": memory.over_capacity(table(s, d, "temporal_fragments"), now, CAPACITY)},
    "integrity": lambda s, d, now: {"violations": quality.violations(*[table(s, d, n) for n in ("entities", "triples", "temporal_fragments", "locations", "vector_links")])},
}


def run(spark: SparkSession, folder: str, out: str, names: Sequence[str], now: datetime) -> dict[str, list[str]]:
    """What each job wrote: the folders below out, by job."""
    jobs = JOBS | {"restore": _restore} | {n: clone_job(*[x.replace("=", ":") for x in n.split(":")[1:]]) for n in names if n.startswith("clone:") and n.count(":") == 2}
    unknown = set(names) - set(jobs)
    if unknown:
        raise ValueError(f"no such jobs: {sorted(unknown)}")
    done = {}
    for name in dict.fromkeys(names):
        results = jobs[name](spark, folder, now)
        for part, df in results.items():
            df.write.mode("overwrite").parquet(f"{out}/{name.replace(':', '_')}/{part}")
        done[name] = sorted(results)
    return done


if __name__ == "__main__":
    run(SparkSession.builder.appName("maintain").getOrCreate(), sys.argv[1], sys.argv[2], sys.argv[3:] or list(JOBS), datetime.now(UTC).replace(tzinfo=None))
