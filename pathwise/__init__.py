"""pathwise: learner analytics and topic recommendation as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark
SQL expressions, joins, windows, aggregates and (where nothing else
fits) Arrow-batched pandas functions.  Sub-packages:

* ``sources``   - table readers, fixture views, sinks
* ``functions`` - column expressions (clips, bands, hashes, rewards)
* ``operators`` - relational operators grouped by family
* ``streaming`` - Structured Streaming versions of the event path
* ``plans``     - end-to-end jobs and the registered query catalogue
"""

__version__ = "0.1.0"
