"""Rating analytics and recommendations as PySpark DataFrame jobs."""
