"""Crisis-message analytics on Spark DataFrames."""

from reliefsignals.operators.filters import Filters, during
from reliefsignals.operators.geocode import GeoIndex
from reliefsignals.operators.prepare import prepare
from reliefsignals.plans.overview import overview
from reliefsignals.schema import Dataset, discover_schema
from reliefsignals.session import configure
from reliefsignals.sources.gazetteer import load_gazetteer
from reliefsignals.sources.predictions import load_predictions, publish_predictions, read_published

__all__ = [
    "Dataset",
    "Filters",
    "GeoIndex",
    "configure",
    "discover_schema",
    "during",
    "load_gazetteer",
    "load_predictions",
    "overview",
    "prepare",
    "publish_predictions",
    "read_published",
]
