"""City manifests: reference systems, bounds, levels, name filters and source adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the three cities: bounds and centre in degrees, equal-area system, area levels.
CITIES = {
    "london": {
        "name": "London", "country_iso": "GB", "language": "en-GB", "epsg": 27700,
        "bbox": (-0.51, 51.28, 0.33, 51.69), "centre": (-0.1276, 51.5074),
        "levels": {"macro": ("borough", 33), "meso": ("msoa", 1011), "micro": ("lsoa", 4994)},
        "deprivation": ("income_decile", 2019), "population_year": 2021,
        "names": [
            "Barking and Dagenham", "Barnet", "Bexley", "Brent", "Bromley", "Camden", "City of London", "Croydon",
            "Ealing", "Enfield", "Greenwich", "Hackney", "Hammersmith and Fulham", "Haringey", "Harrow", "Havering",
            "Hillingdon", "Hounslow", "Islington", "Kensington and Chelsea", "Kingston upon Thames", "Lambeth",
            "Lewisham", "Merton", "Newham", "Redbridge", "Richmond upon Thames", "Southwark", "Sutton",
            "Tower Hamlets", "Waltham Forest", "Wandsworth", "Westminster",
        ],
    },
    "berlin": {
        "name": "Berlin", "country_iso": "DE", "language": "de-DE", "epsg": 25832,
        "bbox": (13.08, 52.34, 13.77, 52.68), "centre": (13.4050, 52.5200),
        "levels": {"macro": ("bezirk", 12), "meso": ("lor_planungsraum", 542), "micro": ("lor_planungsblock", 4471)},
        "deprivation": ("status_index", 2021), "population_year": 2024,
        "names": [
            "Mitte", "Friedrichshain-Kreuzberg", "Pankow", "Charlottenburg-Wilmersdorf", "Spandau",
            "Steglitz-Zehlendorf", "Tempelhof-Schöneberg", "Neukölln", "Treptow-Köpenick", "Marzahn-Hellersdorf",
            "Lichtenberg", "Reinickendorf",
        ],
    },
    "paris": {
        "name": "Paris", "country_iso": "FR", "language": "fr-FR", "epsg": 2154,
        "bbox": (2.22, 48.81, 2.47, 48.91), "centre": (2.3522, 48.8566),
        "levels": {"macro": ("arrondissement", 20), "meso": ("quartier", 80), "micro": ("iris", 992)},
        "deprivation": ("median_uc_decile", 2021), "population_year": 2021,
        "names": [], "department_codes": ["75"],
    },
}
FEATURE_RELEASE = "2026-04-15.0"


def load_manifest(path: str) -> dict:
    """A city manifest in YAML with the same keys as above."""
    import yaml  # optional: only manifests kept in YAML need it

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def city_table(spark: SparkSession, cities: dict | None = None) -> DataFrame:
    """One row per city, for joins against tables of many cities."""
    rows = [(slug, c["name"], c["country_iso"], c["epsg"], *map(float, c["bbox"]), *map(float, c["centre"]),
             list(c["names"])) for slug, c in (cities or CITIES).items()]
    return spark.createDataFrame(
        rows, "city string, name string, country_iso string, epsg int, lon0 double, lat0 double, lon1 double, "
              "lat1 double, centre_lon double, centre_lat double, borough_names array<string>")


_ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def adapter(name: str):
    """Register a function that turns a raw source into the canonical area columns."""
    def keep(function):
        _ADAPTERS[name] = function
        return function
    return keep


def run_adapter(adapter_name: str, /, *args, **kwargs) -> DataFrame:
    if adapter_name not in _ADAPTERS:
        raise ValueError(f"no adapter named {adapter_name!r}; known: {sorted(_ADAPTERS)}")
    return _ADAPTERS[adapter_name](*args, **kwargs)


@adapter("named_areas")
def named_areas(features: DataFrame, city: str, level: str, code: str, name: str, population: str | None = None,
                deprivation: str | None = None, parent: str | None = None) -> DataFrame:
    """Canonical areas from a feature table by column names."""
    def maybe(column, kind):
        return (F.col(column) if column else F.lit(None)).cast(kind)
    return features.select(
        F.lit(city).alias("city"), F.col(code).cast("string").alias("area_code"), F.col(name).cast("string").alias("area_name"),
        F.lit(level).alias("level"), maybe(parent, "string").alias("parent_code"),
        maybe(population, "bigint").alias("population"), maybe(deprivation, "int").alias("deprivation"), "geom")
