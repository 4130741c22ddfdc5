"""refinery: Spark-native table refinement and feature encoding.

Subpackages
-----------
functions  Column -> Column expressions (normalisation, ratios, dates, lists, similarity)
operators  DataFrame -> DataFrame operators (hygiene, joins, grouping, counts, resolution)
sources    readers and writers (CSV/Parquet scans, schema probe, manifests, sinks)
features   fitted encoders as pyspark.ml Estimator/Model pairs, plus their chain and report
plans      end-to-end jobs (integrate, enrich, featurize, profile, topics) and the query registry
streaming  applying fitted encoder models to streaming DataFrames
"""

__version__ = "0.1.0"
