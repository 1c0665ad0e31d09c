"""skytrace: object detection and tracking on gridded, time-stepped fields, expressed as Spark jobs."""

__version__ = "0.1.0"
