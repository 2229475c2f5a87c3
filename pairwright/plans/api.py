"""The public functions.  Inputs are long tables; outputs are one row per pair.

t, t2: (gene, sample, value); a discrete anchor g: (gene, sample, geno); a continuous one: (gene,
sample, value).  Genes are matched by id: under `nodiag`, a gene that is in t and t2 is
the same variable.  All raise ValueError on nulls, gaps, too few samples or targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.dag import greedy_dag, greedy_dag_info
from pairwright.operators.pairwise import Pairs

__all__ = ["rank_llr", "rank_pv", "rank", "gassist_llr", "gassist_pv", "gassist_pijs", "gassist", "gassist_trad", "cassist_llr", "cassist_pv", "cassist_pijs", "cassist", "cassist_trad", "combine", "combine_trad", "greedy_dag", "greedy_dag_info"]


def rank_llr(t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b, llr): log-likelihood ratio of correlation."""
    return Pairs.of(t, t2, seed=seed).run("llr")


def rank_pv(t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b, p): p-value of correlation."""
    return Pairs.of(t, t2, seed=seed).run("pv")


def rank(t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    """(a, b, p): posterior probability of correlation."""
    pairs = Pairs.of(t, t2, nodiag=nodiag, seed=seed)
    pairs.warn_equal_rows()
    return pairs.posteriors()


def _assist(kind: str, g: DataFrame, t: DataFrame, t2: DataFrame, mode: str, nodiag: bool, seed: int) -> DataFrame:
    pairs = Pairs.of(t, t2, g, kind, nodiag, seed)
    if mode == "pij":
        pairs.warn_equal_rows()
        return pairs.posteriors()
    return pairs.run(mode)


def combine(pijs: DataFrame) -> DataFrame:
    """(a, b, p) = (p2 p5 + p4) / 2."""
    return pijs.select("a", "b", ((F.col("p2") * F.col("p5") + F.col("p4")) * 0.5).alias("p"))


def combine_trad(pijs: DataFrame) -> DataFrame:
    """(a, b, p) = p2 p3."""
    return pijs.select("a", "b", (F.col("p2") * F.col("p3")).alias("p"))


def gassist_llr(g: DataFrame, t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    return _assist("discrete", g, t, t2, "llr", False, seed)


def gassist_pv(g: DataFrame, t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b, p1 .. p5): p-values of the five tests with a discrete anchor."""
    return _assist("discrete", g, t, t2, "pv", False, seed)


def gassist_pijs(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    """(a, b, p1 .. p5): posteriors of the five tests with a discrete anchor."""
    return _assist("discrete", g, t, t2, "pij", nodiag, seed)


def gassist(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    return combine(gassist_pijs(g, t, t2, nodiag, seed))


def gassist_trad(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    return combine_trad(gassist_pijs(g, t, t2, nodiag, seed))


def cassist_llr(g: DataFrame, t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    return _assist("continuous", g, t, t2, "llr", False, seed)


def cassist_pv(g: DataFrame, t: DataFrame, t2: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b, p1 .. p5): p-values of the five tests with a continuous anchor."""
    return _assist("continuous", g, t, t2, "pv", False, seed)


def cassist_pijs(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    """(a, b, p1 .. p5): posteriors of the five tests with a continuous anchor."""
    return _assist("continuous", g, t, t2, "pij", nodiag, seed)


def cassist(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    return combine(cassist_pijs(g, t, t2, nodiag, seed))


def cassist_trad(g: DataFrame, t: DataFrame, t2: DataFrame, nodiag: bool = False, seed: int = 0) -> DataFrame:
    return combine_trad(cassist_pijs(g, t, t2, nodiag, seed))
