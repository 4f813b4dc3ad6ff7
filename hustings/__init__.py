"""Poll-series analytics as PySpark DataFrame jobs.

Vocabulary: *entity* (country), *cycle* (election year), *series* (party), *observation* (one poll reading),
*source* (pollster), *lot* (source table), *truth* (actual result), *cutoff* (election date).
"""

__version__ = "0.1.0"
