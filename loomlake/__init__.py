"""loomlake: profile, catalogue, join and curate a lake of loosely related tables with Spark."""
