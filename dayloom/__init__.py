"""dayloom: daily forecasting over a panel of series, written as Spark jobs.

A *panel* is a DataFrame ``(series_id STRING, ds DATE, y DOUBLE, <exog...>)`` with
one row per series and day.  That uniqueness is the size bound behind every
per-series window, array and grouped task in the package: however many raw rows
feed one series, after ``daily_panel`` it holds at most one row per calendar day.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
