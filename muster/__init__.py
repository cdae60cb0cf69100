"""muster: directory, timetable and archive analytics as Spark jobs."""
