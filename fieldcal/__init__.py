"""fieldcal: calibrate mobile sensors against reference stations, as Spark DataFrame operators."""
