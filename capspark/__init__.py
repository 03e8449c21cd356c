"""capspark: burned-in caption data of many videos as Spark tables."""
