"""Series specifications and the registry of named sales datasets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FREQUENCIES = ("D", "W", "MS", "QS", "YS")

# Season length per frequency (fixed values; D, W and MS are given, the other two default to D's).
SEASON_LENGTH = {"D": 7, "W": 4, "MS": 12}

MANDATORY_KEYS = ("date_col", "target", "freq", "description")


def season_length(freq: str) -> int:
    return SEASON_LENGTH.get(freq, 7)


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns of a sales table make the series, and at what frequency."""

    date_col: str
    target: str
    freq: str = "D"
    description: str = ""
    keys: tuple[str, ...] = ()
    required_cols: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.freq not in FREQUENCIES:
            raise ValueError(f"unknown frequency {self.freq!r}, expected one of {FREQUENCIES}")

    @property
    def columns_needed(self) -> tuple[str, ...]:
        """Required columns plus date, target and keys, each once, in order of first mention."""
        wanted = [*self.required_cols, self.date_col, self.target, *self.keys]
        return tuple(dict.fromkeys(wanted))

    @classmethod
    def from_mapping(cls, mapping: dict) -> SeriesSpec:
        """Spec from a user mapping. The frequency falls back to daily."""
        mapping = {"freq": "D", **{k: v for k, v in mapping.items() if v is not None}}
        absent = [k for k in MANDATORY_KEYS if k not in mapping]
        if absent:
            raise ValueError(f"specification lacks the keys {absent}")
        return cls(
            date_col=mapping["date_col"],
            target=mapping["target"],
            freq=mapping["freq"],
            description=mapping["description"],
            keys=tuple(mapping.get("keys", ())),
            required_cols=tuple(mapping.get("required_cols", ())),
        )


def _sales(date_col: str, freq: str, description: str) -> SeriesSpec:
    return SeriesSpec(date_col, "Revenue_INR", freq, description,
                      required_cols=(date_col, "Revenue_INR"))


# The known datasets with their date column, frequency and title.
REGISTRY: dict[str, SeriesSpec] = {
    "pharmacy_daily": _sales("Date", "D", "Pharmacy Daily Sales (Healthcare)"),
    "electronics_gadgets": _sales("Order_Date", "D", "Electronics Gadgets (High-Value)"),
    "grocery_delivery": _sales("Delivery_Date", "D", "Grocery App Delivery (Hyper-local)"),
    "furniture_decor": _sales("Week_End", "W", "Furniture & Home Decor (Seasonal)"),
    "luxury_brand": _sales("Sale_Date", "D", "Luxury Brand (Elite High-Margin)"),
    "automotive_parts": _sales("Date", "D", "Automotive Spare Parts (Steady Growth)"),
    "fashion_apparel": _sales("Date", "D", "Fashion & Apparel (High Seasonality)"),
    "beauty_cosmetics": _sales("Date", "D", "Beauty & Cosmetics (Payday Loyalty)"),
    "home_appliances": _sales("Date", "D", "Home Appliances (Summer Peak)"),
    "toys_games": _sales("Week_End", "W", "Toys & Games (Festive Weekly)"),
}


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a lookup table, one row per dataset."""
    rows = [(name, s.date_col, s.target, s.freq, s.description) for name, s in REGISTRY.items()]
    return spark.createDataFrame(
        rows, "dataset string, date_col string, target string, freq string, description string"
    )


def validate(df: DataFrame, spec: SeriesSpec) -> SeriesSpec:
    """Check that the table has every column the spec names."""
    missing = [c for c in spec.columns_needed if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return spec
