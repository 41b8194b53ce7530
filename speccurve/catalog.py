"""The design catalog: which effects are absorbed and how errors are clustered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (absorbed effects, cluster keys) of the 17 catalog designs.
# An effect written "a*b" is the interaction of two roles; no cluster key
# means heteroskedasticity-robust errors.
_DESIGNS = [
    ("", "firm"),
    ("", ""),
    ("firm time", "firm"),
    ("firm time", ""),
    ("firm ind*time", "firm"),
    ("firm ind*time", ""),
    ("firm region*time", "firm"),
    ("firm region*time", ""),
    ("firm ind*time region*time", "firm"),
    ("firm ind*time region*time", ""),
    ("firm time", "region"),
    ("firm time", "ind"),
    ("ind region time", "ind"),
    ("ind region time", ""),
    ("firm time", "firm time"),
    ("ind time", "firm"),
    ("ind time", ""),
]


@dataclass(frozen=True)
class Design:
    """One estimation design.

    ``fe`` and ``clusters`` hold terms; a term is a tuple of roles (or of
    column names for a manual design), longer than one for an interaction.
    """

    tag: str
    name: str
    fe: tuple[tuple[str, ...], ...]
    clusters: tuple[tuple[str, ...], ...]

    @property
    def robust(self) -> bool:
        return not self.clusters

    @property
    def needs_region(self) -> bool:
        return any("region" in term for term in self.fe + self.clusters)

    def resolve(self, roles: dict[str, str | None]) -> "Design":
        """Replace roles by the column names of one panel."""

        def columns(term):
            return tuple(roles.get(part) or part for part in term)

        return Design(
            self.tag,
            self.name,
            tuple(columns(t) for t in self.fe),
            tuple(columns(t) for t in self.clusters),
        )

    def fe_label(self) -> str:
        return ", ".join("^".join(term) for term in self.fe)

    def cluster_label(self) -> str:
        return ", ".join("^".join(term) for term in self.clusters) or "robust"

    def display(self) -> str:
        absorbed = " ".join("^".join(term) for term in self.fe)
        clusters = " ".join("^".join(term) for term in self.clusters)
        head = f"absorb({absorbed})" if absorbed else "noabsorb"
        vce = f"cluster {clusters}" if clusters else "robust"
        error = f"cluster({clusters})" if clusters else "Robust"
        return f"{head} vce({vce}) Std.Err.={error}"


def _catalog_entry(effects: str, clusters: str) -> Design:
    fe = tuple(tuple(e.split("*")) for e in effects.split())
    cl = tuple((c,) for c in clusters.split())
    flat = "_".join("".join(term) for term in fe)
    by = "_".join(clusters.split())
    tag = (f"ab_{flat}" if fe else "no_absorb") + (f"_cl_{by}" if by else "_robust")
    name = (f"absorb_{flat}" if fe else "no_absorb") + (
        f"_vce_cluster_{by}" if by else "_vce_robust"
    )
    return Design(tag, name, fe, cl)


CATALOG: dict[str, Design] = {
    d.tag: d for d in (_catalog_entry(*row) for row in _DESIGNS)
}


def manual_design(fe_cols, clust_cols, tag: str = "manual") -> Design:
    """A design from column names: any effects, and 0, 1 or 2 clusters.

    An item may be a column or a sequence of columns (an interaction).  Two
    effects joined into one cluster key are written ``[("a", "b")]``.
    """

    def terms(items):
        return tuple((i,) if isinstance(i, str) else tuple(i) for i in items)

    clusters = terms(clust_cols)
    if len(clusters) > 2:
        raise ValueError("at most two cluster variables are supported")
    return Design(tag, tag, terms(fe_cols), clusters)


def fe_pair_clusters(fe_cols) -> list:
    """Cluster list of a manual two-way design: the first effect and the
    interaction of the first two."""
    if len(fe_cols) < 2:
        raise ValueError("a generated second cluster key needs two effects")
    return [fe_cols[0], (fe_cols[0], fe_cols[1])]


def catalog_frame(spark: SparkSession, designs) -> DataFrame:
    """The (fixed-size) list of designs as a DataFrame for joins on spec_tag."""
    rows = [
        (d.tag, d.name, [list(t) for t in d.fe], [list(t) for t in d.clusters], d.needs_region)
        for d in designs
    ]
    raw = spark.createDataFrame(
        rows,
        "spec_tag string, spec_name string, fe_terms array<array<string>>, "
        "cluster_terms array<array<string>>, needs_region boolean",
    )

    def joined(column, separator):
        return F.array_join(
            F.transform(column, lambda t: F.array_join(t, "^")), separator
        )

    absorbed = joined("fe_terms", " ")
    clusters = joined("cluster_terms", " ")
    no_clusters = F.size("cluster_terms") == 0
    return raw.withColumns(
        {
            "fe_label": joined("fe_terms", ", "),
            "cluster_label": F.when(no_clusters, "robust").otherwise(
                joined("cluster_terms", ", ")
            ),
            "display": F.concat(
                F.when(F.size("fe_terms") == 0, "noabsorb").otherwise(
                    F.format_string("absorb(%s)", absorbed)
                ),
                F.when(no_clusters, " vce(robust) Std.Err.=Robust").otherwise(
                    F.format_string(" vce(cluster %s) Std.Err.=cluster(%s)", clusters, clusters)
                ),
            ),
        }
    )
