"""All registered queries; importing this module fills the catalog."""

from . import accounts_and_graph, planted_and_streams, rings_and_models, scans_and_scores
from .registry import CATALOG

__all__ = ["CATALOG", "accounts_and_graph", "planted_and_streams", "rings_and_models", "scans_and_scores"]
