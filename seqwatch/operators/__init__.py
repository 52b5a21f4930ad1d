"""DataFrame-to-DataFrame operators, to be chained with ``DataFrame.transform``. None runs a job by
itself, except ``profile.column_profile`` (see there)."""
