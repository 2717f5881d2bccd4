"""typeloom: PySpark-native analytics for automated type migration of source code."""
