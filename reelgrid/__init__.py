"""reelgrid: media cataloguing and manifest compilation as Spark DataFrame jobs."""
