"""Eigenvalue parameters of Hermitian 3 x 3 matrices, in closed form: expressions only, no Python worker."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T3 = ["t11", "t22", "t33", "t12r", "t12i", "t13r", "t13i", "t23r", "t23i"]
#: Eigenvalues closer than this, as a share of their spread, count as one.
CLOSE = 1e-6


def eigenvalues(t3: DataFrame) -> DataFrame:
    """t3 with l1 >= l2 >= l3, the roots of the characteristic cubic by its trigonometric form, and _w1 to _w3, the
    squared first component of each unit eigenvector: the minor's characteristic polynomial at the eigenvalue over
    the product of its distances to the others. Equal eigenvalues have no eigenvectors of their own; they share
    evenly what the others leave. A NULL term gives NULL."""
    c = F.col
    norm = lambda n: c(f"t{n}r") * c(f"t{n}r") + c(f"t{n}i") * c(f"t{n}i")
    df = t3.withColumns({"_q": (c("t11") + c("t22") + c("t33")) / 3, "_n12": norm("12"), "_n13": norm("13"), "_n23": norm("23")})
    a, b, d = (c(t) - c("_q") for t in ("t11", "t22", "t33"))
    re = c("t12r") * c("t23r") - c("t12i") * c("t23i")
    im = c("t12r") * c("t23i") + c("t12i") * c("t23r")
    det = a * (b * d - c("_n23")) - b * c("_n13") - d * c("_n12") + 2 * (re * c("t13r") + im * c("t13i"))
    df = df.withColumns({"_s": F.sqrt((a * a + b * b + d * d + 2 * (c("_n12") + c("_n13") + c("_n23"))) / 6), "_det": det})
    turn = F.acos(F.least(F.greatest(c("_det") / (2 * c("_s") * c("_s") * c("_s")), F.lit(-1.0)), F.lit(1.0))) / 3
    df = df.withColumn("_f", F.when(c("_s") > 0, turn).otherwise(0.0))
    df = df.withColumns({"l1": c("_q") + 2 * c("_s") * F.cos("_f"), "l3": c("_q") + 2 * c("_s") * F.cos(c("_f") + 2 * math.pi / 3)})
    df = df.withColumn("l2", 3 * c("_q") - c("l1") - c("l3"))
    minor = lambda x: (x - c("t22")) * (x - c("t33")) - c("_n23")
    apart = CLOSE * c("_s")
    first = F.when(c("l1") - c("l2") > apart, minor(c("l1")) / ((c("l1") - c("l2")) * (c("l1") - c("l3"))))
    last = F.when(c("l2") - c("l3") > apart, minor(c("l3")) / ((c("l3") - c("l1")) * (c("l3") - c("l2"))))
    df = df.withColumns({"_x1": first, "_x3": last})
    df = df.withColumns({"_w1": F.coalesce("_x1", (1 - c("_x3")) / 2, F.lit(1 / 3)), "_w3": F.coalesce("_x3", (1 - c("_x1")) / 2, F.lit(1 / 3))})
    return df.select(*t3.columns, "l1", "l2", "l3", "_w1", (1 - c("_w1") - c("_w3")).alias("_w2"), "_w3")


def decomposition(t3: DataFrame, eps: float = 1e-10) -> DataFrame:
    """r, c, entropy, anisotropy and mean alpha in degrees of coherency matrices."""
    c = F.col
    trace = F.greatest(c("t11") + c("t22") + c("t33"), F.lit(eps))
    share = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x / trace, F.lit(1e-12)), F.lit(1.0)))
    df = eigenvalues(t3).withColumns({f"_p{i}": share(c(f"l{i}")) for i in (1, 2, 3)})
    total = lambda f: f(1) + f(2) + f(3)
    angle = lambda w: F.degrees(F.acos(F.least(F.sqrt(F.greatest(w, F.lit(0.0))), F.lit(1.0))))
    low = c("_p2") + c("_p3")
    return df.select(
        "r", "c", (-total(lambda i: c(f"_p{i}") * F.log(c(f"_p{i}"))) / math.log(3)).alias("entropy"),
        F.when(low > eps, (c("_p2") - c("_p3")) / low).when(low.isNotNull(), 0.0).alias("anisotropy"),
        total(lambda i: c(f"_p{i}") * angle(c(f"_w{i}"))).alias("alpha"),
    )
