"""DataFrame to DataFrame operators: mapping, cleaning, scoping, KPIs, series detectors, rankings, risk rules."""
