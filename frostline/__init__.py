"""frostline: Spark-native telemetry analytics for cryostat instrument logs.

Every operator is a lazy ``DataFrame -> DataFrame`` function.  Time-ordered
operators (lag/lead, row numbers) are computed per ``(device, time bucket)``
and stitched over the small bucket table, so no window ever has to hold the
whole history of one device in one task.
"""

from frostline.session import get_session, scratch_path  # noqa: F401

__all__ = ["get_session", "scratch_path"]
