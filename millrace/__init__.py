"""Factory analytics as Spark jobs: every public function takes and returns DataFrames."""
