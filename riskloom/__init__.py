"""riskloom: security analytics over the source code of many repositories, as Spark jobs."""

from riskloom.plans.scan import Scan, scan
from riskloom.plans.train import RiskModel, Settings, train
from riskloom.sources.tree import read_tree

__all__ = ["RiskModel", "Scan", "Settings", "read_tree", "scan", "train"]
