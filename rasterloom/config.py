"""Constants of the raster products, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Weights of the confidence score, and the bands whose low values raise it.
WEIGHTS = {"cpr": 0.20, "dop": 0.12, "tmean": 0.20, "zit": 0.15, "pump": 0.13, "psr": 0.10, "dpsr": 0.05, "slope": 0.05}
INVERTED = ("dop", "tmean", "zit", "slope")
MASKS = ("psr", "dpsr")

#: Product codes in file names and their labels.
PRODUCTS = {"cpr": "CPR", "srd": "SRD", "odd": "ODD", "vol": "VOL", "hlx": "HLX", "evn": "EVN", "trt": "TRT", "gri": "GRI", "sli": "SLI", "sri": "SRI"}

#: Craters of interest (name, latitude, longitude, diameter in km, depth in km is not used here).
CRATERS = [
    ("Shackleton", -89.90, 0.00, 21.0), ("Faustini", -87.30, 84.20, 43.0), ("Haworth", -86.90, -2.20, 51.0),
    ("Shoemaker", -88.10, 44.90, 50.0), ("Cabeus", -85.30, -54.50, 98.0),
]


#: Fixed value: what labels of unknown products begin with.
UNKNOWN_PRODUCT = "DFSAR_"


@dataclass(frozen=True)
class Settings:
    moon_radius_m: float = 1_737_400.0
    cell_m: float = 20.0
    eps: float = 1e-10
    nodata: float = -9999.0
    calibration_db: float = 70.308868
    max_distance: int = 2500
    n_angles: int = 72
    looks_az: int = 19
    looks_rg: int = 3
    valid_fraction: float = 0.5
    cpr_max: float = 20.0
    stretch_low: float = 0.01
    stretch_high: float = 0.99
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))


SETTINGS = Settings()
