"""The graph of notes kept up by changes: names, links, relations and term counts.

What a change touches is found by delta joins.  Of the touched notes old and new names are
compared; only keys whose names differ are resolved anew, and only links and references that ask
for such a key, or lie in a touched note, are looked up again.  All else stays as it was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.notelog import NoteLog
from ..sources.shared import set_down
from .graph import best_names, edges, related, resolve, target_keys

NAMES, LINKS, REFS, ASKED, TERMS = "key string, tier int, path string", "path string, target string", "path string, type string, target string", "key string, path string", "path string, field string, terms array<string>"
RESOLVER, RESOLVED, RELATED, COUNTS = "key string, path string, n_candidates long", "path string, target string, dst string", "path string, type string, dst string", "term string, field string, n long"


def _asked(links: DataFrame, refs: DataFrame) -> DataFrame:
    """``key, path``: the names that a note's links and references may go by."""
    both = target_keys(links.select("path", "target").unionByName(refs.select("path", "target")))
    return both.select("path", F.explode(F.array("whole", "bare")).alias("key")).where("key is not null and key <> ''").select("key", "path").distinct()


def _bags(terms: DataFrame) -> DataFrame:
    """A row a note and field with its terms: a path is written and shuffled once for all of them."""
    return terms.select("path", "field", "terms") if "terms" in terms.columns else terms.groupBy("path", "field").agg(F.collect_list("term").alias("terms"))


def _counted(bags: DataFrame, n: int) -> DataFrame:
    return bags.select(F.explode("terms").alias("term"), "field").withColumn("n", F.lit(n))


class GraphUpkeep:
    """``names, links, refs, terms`` of notes come in; ``resolver, edges, relations, frequencies`` can be read at any time.

    names: rows as ``graph.name_rows`` gives them; links: ``path, target``; refs: as
    ``graph.reference_targets`` gives them; terms: the distinct ``path, term, field``, or
    ``path, field, terms`` as ``search.note_terms`` gives them.
    """

    def __init__(self, log: NoteLog) -> None:
        self.log = log

    def build(self, version: int, parts: dict[str, DataFrame]) -> None:
        """Write all tables anew, as the base of later versions."""
        names = set_down(best_names(parts["names"]), "names")
        self._put(version, parts, None, names, None, resolve(parts["links"].distinct(), names).select("path", "target", "dst"), _relations(parts["refs"], names), None)
        self._put_terms(version, parts["terms"], None)
        self.log.mark(version, base=True)

    def apply(self, version: int, touched: DataFrame, parts: dict[str, DataFrame]) -> bool:
        """Take in a change: ``touched(path)``, removed notes included, and what these notes now hold.

        False, and nothing done, for a version that was written before.
        """
        log = self.log
        if log.done(version):
            return False
        touched = set_down(touched.select("path").distinct(), "touched")
        parts = {name: df if name == "terms" else set_down(df, f"new-{name}") for name, df in parts.items()}
        places = log.buckets_of(touched, "path")
        mine = lambda table, schema: log.rows(table, schema, "path", buckets=places).join(touched, "path", "left_semi")
        was, now = mine("names", NAMES).select("key", "tier", "path").distinct(), parts["names"].select("key", "tier", "path").distinct()
        keys = set_down(was.exceptAll(now).unionByName(now.exceptAll(was)).select("key").distinct(), "changed-names")
        spots = log.buckets_of(keys, "key")
        rest = log.rows("names_by_key", NAMES, "path", buckets=spots).join(touched, "path", "left_anti")
        fresh = set_down(best_names(rest.unionByName(now).join(keys, "key", "left_semi")), "resolver-rows")
        # notes elsewhere that ask for a changed name
        asking = log.rows("asked", ASKED, "path", buckets=spots).join(keys, "key", "left_semi").join(touched, "path", "left_anti").select("path").distinct()
        sources = set_down(touched.unionByName(asking), "sources")
        homes = log.buckets_of(sources, "path")
        kept = lambda table, schema: log.rows(table, schema, "path", buckets=homes).join(touched, "path", "left_anti").join(sources, "path", "left_semi")
        links = set_down(kept("links", LINKS).unionByName(parts["links"].select("path", "target")).distinct(), "links-again")
        refs = set_down(kept("refs", REFS).unionByName(parts["refs"].select("path", "type", "target")), "refs-again")
        wanted = set_down(_asked(links, refs).select("key").distinct(), "wanted-names")
        known = log.rows("resolver", RESOLVER, "key", buckets=log.buckets_of(wanted, "key")).join(keys, "key", "left_anti").unionByName(fresh).join(wanted, "key", "left_semi")
        self._put(version, parts, touched, fresh, keys, resolve(links, known).select("path", "target", "dst"), _relations(refs, known), sources)
        self._put_terms(version, parts["terms"], touched, mine("terms", TERMS))
        log.mark(version)
        return True

    def _put(self, version: int, parts: dict[str, DataFrame], touched: DataFrame | None, resolver: DataFrame, keys: DataFrame | None, resolved: DataFrame, relations: DataFrame, sources: DataFrame | None) -> None:
        put, names = self.log.put, parts["names"].select("key", "tier", "path")
        put(version, "names", names, "path", touched)
        put(version, "names_by_key", names, "key", touched)
        put(version, "links", parts["links"].select("path", "target"), "path", touched)
        put(version, "refs", parts["refs"].select("path", "type", "target"), "path", touched)
        put(version, "asked", _asked(parts["links"], parts["refs"]), "key", touched)
        put(version, "resolver", resolver.select("key", "path", "n_candidates"), "key", keys)
        put(version, "resolved", resolved, "path", sources)
        put(version, "related", relations, "path", sources)

    def _put_terms(self, version: int, terms: DataFrame, touched: DataFrame | None, was: DataFrame | None = None) -> None:
        """Terms are found once: what is counted is what was written.  was: the terms that the touched notes had."""
        now = _counted(self.log.put(version, "terms", _bags(terms), "path", touched), 1)
        both = now if was is None else now.unionByName(_counted(was, -1))
        self._put_counts(version, both.groupBy("term", "field").agg(F.sum("n").alias("n")).where("n <> 0"))

    def _put_counts(self, version: int, counts: DataFrame) -> None:
        self.log.put(version, "frequencies", counts.select("term", "field", F.col("n").cast("long").alias("n")), "term")

    def compact(self, version: int) -> None:
        """All tables as they are now, as a new base."""
        parts = {"names": self.log.rows("names", NAMES, "path"), "links": self.log.rows("links", LINKS, "path"), "refs": self.log.rows("refs", REFS, "path")}
        self._put(version, parts, None, self.resolver(), None, self.log.rows("resolved", RESOLVED, "path"), self.log.rows("related", RELATED, "path"), None)
        self.log.put(version, "terms", self.log.rows("terms", TERMS, "path"), "path")
        self._put_counts(version, self.frequencies())
        self.log.mark(version, base=True)

    def resolver(self) -> DataFrame:
        return self.log.rows("resolver", RESOLVER, "key")

    def edges(self) -> DataFrame:
        return edges(self.log.rows("resolved", RESOLVED, "path"))

    def relations(self) -> DataFrame:
        return self.log.rows("related", RELATED, "path").select(F.col("path").alias("src"), "type", "dst")

    def frequencies(self) -> DataFrame:
        """``term, field, n``: in how many notes a term is."""
        return self.log.sums("frequencies", ["term", "field"], COUNTS)


def _relations(refs: DataFrame, names: DataFrame) -> DataFrame:
    return related(resolve(refs, names)).select(F.col("src").alias("path"), "type", "dst")
