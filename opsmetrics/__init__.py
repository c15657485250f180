"""Call-centre reporting on Spark: facts, scorecards, series, rankings, segments."""
