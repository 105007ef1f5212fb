"""Land-development analytics as Spark jobs: inventory, bookings, labels, polygons, rules, scores, evaluation."""

from acreage.session import get_session

__all__ = ["get_session"]
