"""Learning-path analytics on Spark: validated inboxes, study schedules, progress and exam readiness."""
