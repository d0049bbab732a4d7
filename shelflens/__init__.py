"""Price-intelligence jobs for Spark: every public function takes and returns DataFrames."""
