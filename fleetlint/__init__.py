"""fleetlint: audits fleets of source repositories as Spark jobs."""
