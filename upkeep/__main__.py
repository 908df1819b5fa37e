import sys

from upkeep.runner import main

sys.exit(main())
