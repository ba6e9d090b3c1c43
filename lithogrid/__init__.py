"""Sourced map features to attributed voxel tables, as Spark jobs."""

from lithogrid.plans.build import BuildResult, build, build_from_osm
from lithogrid.plans.publish import GateError, publish

__all__ = ["BuildResult", "GateError", "build", "build_from_osm", "publish"]
