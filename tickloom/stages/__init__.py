"""Order-dependent stages of one event: clustering, time assignment, rescue; NumPy inside, grouped by Spark outside."""
