"""Distribution analytics and intermittent-demand forecasting as Spark jobs."""
