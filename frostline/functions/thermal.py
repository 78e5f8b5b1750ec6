"""Thermal occupation and the attenuator-chain noise model.

Everything is a Column expression (whole-stage codegen); parameters that do
not depend on data (room occupation, linear losses) are folded on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.functions.columns import col

# Physical constants and model defaults.
K_B = 1.380649e-23
H_PLANCK = 6.62607015e-34
EM_STAGE_KEYS = ["T_50K", "T_4K", "T_Still", "T_MXC"]
EM_DEFAULT_ATTEN_DB = {"T_50K": 0.0, "T_4K": 20.0, "T_Still": 20.0, "T_MXC": 20.0}
EM_ROOM_TEMP_DEFAULT_K = 300.0
EM_DEFAULT_FREQ_GHZ = 5.0
# End of fixed values.


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def thermal_n(temp_k, freq_ghz: float) -> Column:
    """Bose occupation ``1/expm1(h f / k T)``; NULL for T non-finite or <= 0."""
    t = col(temp_k).cast("double")
    hf_over_k = H_PLANCK * float(freq_ghz) * 1e9 / K_B
    x = F.lit(hf_over_k) / F.greatest(t, F.lit(1e-9))
    # expm1 overflows to +inf for tiny T; 1/inf = 0 as in IEEE arithmetic
    n = F.try_divide(F.lit(1.0), F.expm1(x))
    return F.when(t.isNotNull() & _finite(t) & (t > 0), n)


def thermal_n_scalar(temp_k: float, freq_ghz: float) -> float | None:
    """Driver-side F10 for constant inputs (room temperature)."""
    if temp_k is None or not math.isfinite(temp_k) or temp_k <= 0:
        return None
    x = H_PLANCK * float(freq_ghz) * 1e9 / (K_B * max(temp_k, 1e-9))
    try:
        return 1.0 / math.expm1(x)
    except OverflowError:
        return 0.0


def n_to_teff(n, freq_ghz: float) -> Column:
    """effective temperature of an occupation; NULL for n non-finite or < 0."""
    x = col(n).cast("double")
    hf_over_k = H_PLANCK * float(freq_ghz) * 1e9 / K_B
    t = F.try_divide(F.lit(hf_over_k), F.log1p(F.lit(1.0) / F.greatest(x, F.lit(1e-20))))
    return F.when(x.isNotNull() & _finite(x) & (x >= 0), t)


def db_to_linear(db: float) -> float:
    """attenuation in dB -> linear loss factor."""
    return 10 ** (float(db) / 10.0)


def is_unity(loss: float) -> bool:
    """``isclose(loss, 1)`` with rtol 1e-5, atol 1e-8 (NumPy convention)."""
    return abs(loss - 1.0) <= 1e-8 + 1e-5 * 1.0


def em_chain_columns(stage_temps: dict, attens_db: dict | None = None,
                     freq_ghz: float = EM_DEFAULT_FREQ_GHZ,
                     room_k: float = EM_ROOM_TEMP_DEFAULT_K,
                     stages=tuple(EM_STAGE_KEYS)) -> tuple[dict, dict]:
    """Fold the beam-splitter model over the stages in order.

    ``n_out = n_in / L + (1 - 1/L) * n(T_stage)``; a stage with L ~ 1 passes
    the occupation through (its temperature is then unused, even if missing).
    Returns ``({stage: n_col}, {stage: teff_col})``; NULL propagates downstream.
    """
    attens = {**EM_DEFAULT_ATTEN_DB, **(attens_db or {})}
    n0 = thermal_n_scalar(room_k, freq_ghz)
    n_in: Column = F.lit(n0).cast("double")
    n_out_map, teff_map = {}, {}
    for s in stages:
        loss = db_to_linear(attens[s])
        if is_unity(loss):
            n_out = n_in
        else:
            n_out = n_in / F.lit(loss) + F.lit(1.0 - 1.0 / loss) * thermal_n(stage_temps[s], freq_ghz)
        n_out_map[s] = n_out
        teff_map[s] = n_to_teff(n_out, freq_ghz)
        n_in = n_out
    return n_out_map, teff_map
