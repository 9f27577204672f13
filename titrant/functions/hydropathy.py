"""Charge-hydropathy diagram as column expressions."""

from pyspark.sql import Column, functions as F

from titrant import constants as K
from titrant.functions.charge import count_letters, net_charge_simple


def mean_scaled_hydropathy(seq: Column) -> Column:
    total = F.lit(0.0)
    for letter, value in K.HYDROPATHY.items():
        scaled = (value - K.HYDROPATHY_MIN) / K.HYDROPATHY_RANGE
        total = total + count_letters(seq, letter) * F.lit(scaled)
    return F.try_divide(total, F.length(seq))


def mean_net_charge(seq: Column) -> Column:
    return F.try_divide(F.abs(net_charge_simple(seq)).cast("double"), F.length(seq))


def boundary_charge(hydropathy: Column) -> Column:
    return F.lit(K.BOUNDARY_SLOPE) * hydropathy + F.lit(K.BOUNDARY_INTERCEPT)


def place_on_diagram(df, seq: str = "seq"):
    """Adds the seven diagram columns; strictly above the line is disorder-prone."""
    c = F.col(seq)
    return (
        df.withColumn("mean_scaled_hydropathy", mean_scaled_hydropathy(c))
        .withColumn("mean_net_charge", mean_net_charge(c))
        .withColumn("signed_net_charge", net_charge_simple(c))
        .withColumn("n_residues", F.length(c))
        .withColumn("boundary", boundary_charge(F.col("mean_scaled_hydropathy")))
        .withColumn("distance_from_boundary", F.col("mean_net_charge") - F.col("boundary"))
        .withColumn("predicted_disordered", F.col("distance_from_boundary") > 0)
    )
