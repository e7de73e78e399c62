"""Election, campaign-finance and social-profile analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or columns) and returns a DataFrame (or column).
Plans stay lazy: data checks are expressed inside the plan and raise while it runs.
"""

__version__ = "0.1.0"
